"""Tables whose cells span columns and rows, from their written cells to a grid.

Written cells are rows ``keys, row_idx, nth, wide, high, head, text``: the nth cell of a line, over so many columns and lines.
A line without cells has one row with ``nth`` -1 and ``wide`` 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.operators import cells as T
from tableweave.operators.cells import COL, HEADER, ROW, VALUE
from tableweave.plans.materialize import cut

_OPEN = "array<struct<col: int, text: string, left: int>>"


def _once(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line(open_: Column, cells: Column) -> Column:
    """One line on the columns that cells of lines before it still occupy: ``texts`` and what is ``open`` below it.

    Before each cell the occupied columns that come next are filled; what is left of them follows the last cell.
    """
    going_on = lambda taken: F.transform(F.filter(taken, lambda o: o["left"] > 1), lambda o: F.struct(o["col"].alias("col"), o["text"].alias("text"), (o["left"] - 1).alias("left")))
    texts_of = lambda taken: F.transform(taken, lambda o: o["text"])

    def put(s: Column, cell: Column) -> Column:
        here = lambda o, k: o["col"] <= F.size(s["texts"]) + k
        taken, rest = F.filter(s["rest"], here), F.filter(s["rest"], lambda o, k: ~here(o, k))

        def placed(taken: Column) -> Column:
            at = F.size(s["texts"]) + F.size(taken)
            wide = F.greatest(cell["wide"], F.lit(0))
            new = F.when((cell["high"] > 1) & (wide > 0), F.transform(F.sequence(at, at + wide - 1), lambda c: F.struct(c.alias("col"), cell["text"].alias("text"), (cell["high"] - 1).alias("left"))))
            texts = F.concat(s["texts"], texts_of(taken), F.array_repeat(cell["text"], wide))
            return F.struct(texts.alias("texts"), rest.alias("rest"), F.concat(s["open"], going_on(taken), F.coalesce(new, F.array().cast(_OPEN))).alias("open"))

        return _once(taken, placed)

    start = F.struct(F.array().cast("array<string>").alias("texts"), open_.alias("rest"), F.array().cast(_OPEN).alias("open"))
    end = lambda s: F.struct(F.concat(s["texts"], texts_of(s["rest"])).alias("texts"), F.concat(s["open"], going_on(s["rest"])).alias("open"))
    return F.aggregate(cells, start, put, end)


def expanded_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row_idx, col_idx, value``: every column and line that a cell spans has its text.

    A fold over a table's lines keeps what is open by column, so a span in the middle of a line stays in its columns. Cells
    that reach below the last line make lines of their own, of what is open alone. Lines may differ in length. A table is
    one row meanwhile.
    """
    lines = spans.groupBy(*keys, ROW).agg(F.sort_array(F.collect_list(F.struct("nth", F.greatest("wide", F.lit(0)).alias("wide"), F.greatest("high", F.lit(1)).alias("high"), "text"))).alias("cells"))
    tables = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ROW, "cells"))).alias("lines"))
    start = F.struct(F.array().cast("array<array<string>>").alias("grid"), F.array().cast(_OPEN).alias("open"))
    step = lambda s, line: _once(_line(s["open"], line["cells"]), lambda x: F.struct(F.concat(s["grid"], F.array(x["texts"])).alias("grid"), x["open"].alias("open")))

    def below(s: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(s["open"], lambda o: o["left"])), F.lit(0))
        more = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: F.transform(F.filter(s["open"], lambda o: o["left"] >= n), lambda o: o["text"]))
        return F.when(most > 0, F.concat(s["grid"], more)).otherwise(s["grid"])

    grids = tables.select(*keys, F.aggregate("lines", start, step, below).alias("grid"))
    return grids.select(*keys, F.posexplode("grid").alias(ROW, "line")).select(*keys, ROW, F.posexplode("line").alias(COL, VALUE))


def table_cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Written cells as a cell relation ``keys, row_idx, col_idx, header, value``: the leading lines of heads alone, at least
    one, become stacked headers; rows are numbered from the first line behind them. Short lines are padded.

    Both are read several times, so they are written once: pages are parsed once, spans expanded once."""
    spans = cut(spans, "spans-written")
    grid = cut(expanded_spans(spans, keys), "spans-grid")
    plain = spans.groupBy(*keys, ROW).agg(F.bool_and(F.coalesce("head", F.lit(False)) | (F.col("nth") < 0)).alias("heads"))
    heads = plain.groupBy(*keys).agg(F.greatest(F.coalesce(F.min(F.when(~F.col("heads"), F.col(ROW))), F.max(ROW) + 1), F.lit(1)).alias("__heads"))
    wide = grid.groupBy(*keys).agg(F.max(COL).alias("__last"), F.max(ROW).alias("__rows")).join(heads, keys)
    places = wide.select(*keys, "__heads", F.explode(F.sequence(F.lit(0), F.col("__rows"))).alias(ROW), "__last").select(*keys, "__heads", ROW, F.explode(F.sequence(F.lit(0), F.col("__last"))).alias(COL))
    full = places.join(grid, [*keys, ROW, COL], "left").withColumn(VALUE, F.coalesce(VALUE, F.lit("")))
    headers = T.stack_headers(full.filter(F.col(ROW) < F.col("__heads")).select(*keys, F.col(ROW).alias("line"), COL, VALUE), keys)
    body = full.filter(F.col(ROW) >= F.col("__heads")).withColumn(ROW, F.col(ROW) - F.col("__heads")).select(*keys, ROW, COL, VALUE)
    return body.join(headers, [*keys, COL]).select(*keys, ROW, COL, HEADER, VALUE)
