"""Character references in the titles and texts of pages."""

from __future__ import annotations

from tableweave.sources import html_tables

PAGE = "<h1>A &amp; b &amp</h1>"


def test_references_without_a_semicolon(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    told = lambda **more: [r.title for r in html_tables.titles_and_texts(pages, ["id"], **more).orderBy("id").collect()]
    assert told() == ["A & b &", ""]
    assert told(terminated=True) == ["A & b &amp", ""]
