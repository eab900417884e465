"""Markdown and CSV texts to cells and back: the edges of the engine, where tables are exchanged as texts."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.operators.cells import BLOCK_BITS, COL, HEADER, ROW, VALUE, to_rows

PIECE = "piece"


def markdown_cells(line: Column) -> Column:
    """The trimmed cells of a line ``| a | b |``."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def from_markdown(docs: DataFrame, keys: list[str], text_col: str = "markdown") -> DataFrame:
    """Markdown tables as cells: the first line has the headers, the second is skipped. Under three lines there is no table."""
    lines = docs.select(*keys, F.split(F.trim(text_col), "\n").alias("l")).filter(F.size("l") >= 3)
    # headers first: each line would else go on with all lines of its text
    heads = lines.select(*keys, markdown_cells(F.get("l", F.lit(0))).alias("headers"), F.slice("l", 3, F.size("l") - 2).alias("body"))
    heads = heads.select(*keys, "headers", F.posexplode("body").alias(ROW, "line"))
    cell = heads.select(*keys, ROW, "headers", markdown_cells(F.col("line")).alias("c"))
    each = cell.select(*keys, ROW, "c", F.posexplode("headers").alias(COL, HEADER))
    return each.select(*keys, ROW, COL, HEADER, F.coalesce(F.get("c", F.col(COL)), F.lit("")).alias(VALUE))


def markdown_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def _joined_lines(cells: DataFrame, keys: list[str], line: Callable[[Column, Column], Column]) -> DataFrame:
    """``keys, headers, body``: the headers of each table's first row, and its rows' lines (of row and cells), in order.

    Lines are joined by blocks of rows, then blocks, so that only a table's text itself is ever in one place.
    """
    dealt = cells.withColumn("__block", F.shiftright(ROW, BLOCK_BITS)).repartition(*keys, "__block")
    rows = to_rows(dealt, [*keys, "__block"])
    text = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(c)))), lambda x: x[c]), "\n")
    lines = rows.select(*keys, "__block", ROW, "headers", line(F.col(ROW), F.col("cells")).alias("__line"))
    blocks = lines.groupBy(*keys, "__block").agg(text(ROW, "__line").alias("__text"), F.min_by("headers", ROW).alias("headers"))
    return blocks.groupBy(*keys).agg(F.min_by("headers", "__block").alias("headers"), text("__block", "__text").alias("body"))


def to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each table as a Markdown text: ``keys, markdown``. A table without rows has no cells, and so no text."""
    told = _joined_lines(cells, keys, lambda _, c: markdown_line(c))
    rule = markdown_line(F.transform("headers", lambda h: F.lit("---")))
    return told.select(*keys, F.concat_ws("\n", markdown_line(F.col("headers")), rule, "body").alias("markdown"))


def to_markdown_pieces(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, piece, markdown``: each block of a table's rows as a Markdown text of its own, with the headers; a table of any
    length is never one text."""
    return to_markdown(cells.withColumn(PIECE, F.shiftright(ROW, BLOCK_BITS)), [*keys, PIECE])


def from_markdown_pieces(docs: DataFrame, keys: list[str], text_col: str = "markdown") -> DataFrame:
    """The cells of ``to_markdown_pieces``, rows numbered on from piece to piece."""
    place = F.shiftleft(PIECE, BLOCK_BITS) + F.col(ROW)
    return from_markdown(docs, [*keys, PIECE], text_col).select(*keys, place.alias(ROW), COL, HEADER, VALUE)


def labelled_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each table as a text for a reader who names rows and columns: ``col:`` before the headers, ``row i:`` before rows."""
    told = _joined_lines(cells, keys, lambda row, c: F.concat(F.lit("row "), row.cast("string"), F.lit(": "), markdown_line(c)))
    return told.select(*keys, F.concat_ws("\n", F.concat(F.lit("col: "), markdown_line(F.col("headers"))), "body").alias("display"))


def repaired_csv_line(line: Column, n_header: Column) -> Column:
    """A CSV line without the one empty cell at its end that it has more than the header."""
    extra = F.size(F.split(line, ",")) == n_header + 1
    return F.when(extra & line.rlike(r",\s*$"), F.regexp_replace(line, r",\s*$", "")).otherwise(line)


def repaired_csv(text: Column) -> Column:
    """A CSV text with ``repaired_csv_line`` applied to all lines but the first."""
    lines = F.split(F.trim(text), "\n")
    n = F.size(F.split(F.get(lines, F.lit(0)), ","))
    return F.array_join(F.transform(lines, lambda line, i: F.when(i == 0, line).otherwise(repaired_csv_line(line, n))), "\n")


def from_csv_texts(docs: DataFrame, keys: list[str], text_col: str = "csv") -> DataFrame:
    """``keys, valid, headers, rows`` of CSV texts: whether they can be read at all, and their cells.

    The one empty cell that lines have too much is repaired first. Headers and rows are null where a line has more cells
    than the header, or nothing can be read; shorter lines are filled with empty cells. Quotes may hold commas and lines.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def read(text: str | None) -> tuple[bool, list[str] | None, list[list[str]] | None]:
        try:
            lines = [r for r in csv.reader(io.StringIO(text or "")) if r]
        except csv.Error:
            return False, None, None
        if not lines or any(len(r) > len(lines[0]) for r in lines):
            return True, None, None
        return True, lines[0], [r + [""] * (len(lines[0]) - len(r)) for r in lines[1:]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = pd.DataFrame([read(t) for t in x["__csv"]], columns=["valid", "headers", "rows"])
            yield pd.concat([x[keys].reset_index(drop=True), found], axis=1)

    return docs.select(*keys, repaired_csv(F.col(text_col)).alias("__csv")).mapInPandas(run, f"{kinds}, valid boolean, headers array<string>, rows array<array<string>>")


def json_rows_to_csv(payload: Column, codes: dict[str, str]) -> Column:
    """A JSON array of objects with short codes, in any case, as a CSV text with full names; commas in cells are spaces."""
    rows = F.transform(F.from_json(payload, "array<map<string,string>>"), lambda m: F.transform_keys(m, lambda k, v: F.lower(k)))
    cell = lambda m, code: F.replace(F.coalesce(F.element_at(m, F.lit(code.lower())), F.lit("")), F.lit(","), F.lit(" "))
    body = F.transform(rows, lambda m: F.concat_ws(", ", *[cell(m, c) for c in codes]))
    return F.concat_ws("\n", F.lit(", ".join(codes.values())), F.array_join(body, "\n"))
