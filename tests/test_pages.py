"""The page readers: what a query asks for, how many pages at once, and how tags and references are read."""

from __future__ import annotations

import random
from html.parser import HTMLParser

from tableweave.plans import inputs, page_queries
from tableweave.sources import html_tables, html_tree

SF = "/root/testdata/sf0.001"
PAGE = '<hgroup><h1>A &amp; b &amp</h1></hgroup><h2>Abstract</h2><p>Text</p><table><tr><th>n</th></tr><tr><td>1</td></tr></table>'


def test_only_what_is_asked_for_is_read(monkeypatch):
    monkeypatch.setattr(html_tables, "sections_of", lambda root: 1 / 0)
    assert list(html_tables.page_of(PAGE, ("title", "tables"))) == ["title", "tables"]


def test_small_files_become_several_tasks(spark):
    df = page_queries._pages(spark, SF)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == inputs.load(spark, SF, "customer").count()


def test_results_leave_the_worker_in_slices(spark):
    n = 2 * html_tables.PAGES_AT_ONCE + 3
    pages = spark.createDataFrame([(k, PAGE.replace("Text", str(k))) for k in range(n)], "id int, html string").coalesce(1)
    sizes = html_tables.parse_pages(pages, ["id"]).mapInArrow(lambda batches: (b.select(["id"]).slice(0, 1) for b in batches), "id int").collect()
    assert len(sizes) >= 1
    rows = html_tables.parse_pages(pages, ["id"]).orderBy("id").collect()
    assert [(r.id, r.abstract) for r in rows] == [(k, f"{k}\n| n |\n| --- |\n| 1 |") for k in range(n)]


class _Plain(html_tree._Builder):
    parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag


def test_plain_tags_are_read_as_the_parser_reads_them():
    bits = ["<p>", "</p>", "<td colspan=2 rowspan=3>", "<TD>", "<a href='x'>", '<a b="c" b="d">', "<br/>", '<a b="x>y">', "<script>", "</script>", "<title>", "</title>", "<style>", "&amp", "&lt;", "<", "</", ">", "x", "<a b=c/>", "</p >"]
    bits += ['<a  b="">', '<a b= "c">', "<!-- x -->", "<textarea>", "<a b=c\n>", "<a b=c d>", "<plaintext>", "<noscript>", "\n", "<p", ' c="1"', '<a b="a&amp;b">', "<a B=c>", "<x:y>", '<a b="c"d="e">', "<a b=c", "</p"]
    dealt = random.Random(1)
    shown = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, [shown(c) for c in n.children])
    for _ in range(3000):
        html = "".join(dealt.choices(bits, k=dealt.randint(1, 14)))
        plain = _Plain()
        plain.feed(html)
        plain.close()
        assert shown(html_tree.tree_of(html)) == shown(plain.root), html


def test_queries_ask_for_what_they_need(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(html_tables, "parse_pages", lambda pages, keys, html_col="html", parts=(): asked.append(parts) or 1 / 0)
    for query, parts in ((page_queries.full_text_sections, ("sections",)), (page_queries.full_text_heads, ("title", "abstract"))):
        try:
            query(spark, SF)
        except ZeroDivisionError:
            assert asked[-1] == parts


def test_single_tables_are_dealt_out(spark):
    df = page_queries.single_tables(spark, SF)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pages_of_plain_tags_are_read_without_the_parser(monkeypatch):
    bits = ["<p>", "</p>", "<td colspan=2>", "</td>", '<a b="c" b="d">', "<br>", "<tr>", "</tr>", "<table>", "</table>", "<li>", "&amp", "&lt;", "x ", "&", "\n", ">", '"', "<h1>", "</h1>", "</section>"]
    dealt = random.Random(2)
    shown = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, [shown(c) for c in n.children])
    pages = ["".join(dealt.choices(bits, k=dealt.randint(0, 14))) for _ in range(2000)]
    want = []
    for html in pages:
        plain = _Plain()
        plain.feed(html)
        plain.close()
        want.append(shown(plain.root))
    monkeypatch.setattr(html_tree, "_Builder", lambda: 1 / 0)
    assert [shown(html_tree.tree_of(html)) for html in pages] == want
