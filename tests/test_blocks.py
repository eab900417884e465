"""Tables of more lines than one block has."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableweave.operators import cells as T
from tableweave.operators import codecs

KEYS = ["doc_id"]


@pytest.fixture(scope="module")
def long_cells(spark):
    """Two columns over three blocks of lines, every third line empty, and a column with nothing in it."""
    n = 3 << T.BLOCK_BITS
    row, col = (F.col("id") / 3).cast("int"), (F.col("id") % 3).cast("int")
    value = F.when((row % 3 == 1) | (col == 2), " ").otherwise(row.cast("string"))
    return spark.range(3 * n).select(F.lit(7).alias("doc_id"), row.alias("row_idx"), col.alias("col_idx"), F.element_at(F.array(F.lit("n"), F.lit("n"), F.lit("")), col + 1).alias("header"), value.alias("value")), n


def test_repair_closes_up_lines_over_blocks(long_cells):
    cells, n = long_cells
    want = [r for r in range(n) if r % 3 != 1]
    got = T.repair_headers(cells, KEYS).orderBy("col_idx", "row_idx").collect()
    assert [(r.row_idx, r.col_idx, r.header, r.value) for r in got] == [(k, c, f"n_{c}", str(r)) for c in (0, 1) for k, r in enumerate(want)]


def test_markdown_and_labels_over_blocks(long_cells):
    cells, n = long_cells
    some = cells.filter("col_idx < 2")
    pieces = codecs.to_markdown_pieces(some, KEYS)
    assert pieces.count() == 3
    back = codecs.from_markdown_pieces(pieces, KEYS).withColumn("value", F.when(F.col("value") == "", " ").otherwise(F.col("value")))
    assert back.exceptAll(some).isEmpty() and back.count() == 2 * n
    (text,) = [r.markdown for r in codecs.to_markdown(some, KEYS).collect()]
    assert text.split("\n")[2:] == [f"| {r} | {r} |" if r % 3 != 1 else "|   |   |" for r in range(n)]
    (shown,) = [r.display for r in codecs.labelled_rows(some, KEYS).collect()]
    assert shown.split("\n")[0] == "col: | n | n |" and shown.split("\n")[-1] == f"row {n - 1}: | {n - 1} | {n - 1} |"


def test_lines_are_not_read_with_all_others_of_their_text(spark):
    """A text of 20,000 lines: with all lines beside each that would be 400 million."""
    text = "\n".join(["| a |", "| --- |", *[f"| {k} |" for k in range(20_000)]])
    docs = spark.createDataFrame([(1, text)], "doc_id int, markdown string")
    plan = codecs.from_markdown(docs, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate posexplode(body" in x)
    assert "[2]" in generate or "body" in generate
    assert codecs.from_markdown(docs, KEYS).count() == 20_000


def test_rows_are_numbered_over_blocks(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("doc_id"), (F.col("id") * 5 - 50).alias("k"))
    got = T.numbered_in_blocks(df, KEYS, "k", "n", 4).orderBy("doc_id", "k").collect()
    assert [r.n for r in got] == [*range(50), *range(50)]
