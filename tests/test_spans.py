from __future__ import annotations

import random

from tableweave.operators import spans as S


def brute(lines):
    """A grid with what is open by column, one cell after the other."""
    grid, open_ = [], []
    for cells in [*lines, *[None] * 50]:
        if cells is None and not open_:
            break
        out, below, waiting = [], [], list(open_)

        def fill(out, below, o):
            out.append(o[1])
            if o[2] > 1:
                below.append((o[0], o[1], o[2] - 1))

        for wide, high, text in cells or []:
            while waiting and waiting[0][0] <= len(out):
                fill(out, below, waiting.pop(0))
            for _ in range(wide):
                if high > 1:
                    below.append((len(out), text, high - 1))
                out.append(text)
        for o in waiting:
            fill(out, below, o)
        grid.append(out)
        open_ = below
    return grid


def test_against_a_plain_grid(spark):
    r = random.Random(6)
    tables = [[[(r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2, 3]), f"{t}.{n}.{k}") for k in range(r.randint(0, 4))] for n in range(r.randint(1, 6))] for t in range(80)]
    rows = []
    for t, lines in enumerate(tables):
        for n, cells in enumerate(lines):
            rows += [(t, n, k, *c[:2], False, c[2]) for k, c in enumerate(cells)] or [(t, n, -1, 0, 1, False, "")]
    df = spark.createDataFrame(rows, "t int, row_idx int, nth int, wide int, high int, head boolean, text string").repartition(3)
    got = {}
    for x in S.expanded_spans(df, ["t"]).collect():
        got[x.t, x.row_idx, x.col_idx] = x.value
    want = {(t, n, k): v for t, lines in enumerate(tables) for n, line in enumerate(brute(lines)) for k, v in enumerate(line)}
    assert got == want


def test_spans_in_mid_line_shift_nothing(spark):
    from tableweave.sources import html_tables

    page = "<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td>1</td><td rowspan=2>both</td><td>3</td></tr><tr><td>4</td><td>6</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<table></table>")], "page int, html string")
    cells = S.table_cells(html_tables.span_cells(pages, ["page"]), ["page", "table_id"])
    got = sorted((x.row_idx, x.col_idx, x.header, x.value) for x in cells.collect())
    assert got == [(0, 0, "A", "1"), (0, 1, "B", "both"), (0, 2, "C", "3"), (1, 0, "A", "4"), (1, 1, "B", "both"), (1, 2, "C", "6")]
    # the other reading shifts what follows the span
    assert html_tables.grid_of(html_tables.tree_of(page).all("table")[0])[0][2] != ["4", "both", "6"]


def test_cells_of_pages_leave_the_worker_as_arrow_batches(spark):
    from tableweave.plans import page_queries

    plan = page_queries.expanded_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_pages_are_parsed_once(spark):
    from tableweave.plans import page_queries

    plan = page_queries.spanned_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan  # all that reads cells again reads the written table
