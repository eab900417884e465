from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tableweave.operators import cells as T
from tableweave.operators import cleanup as C
from tableweave.plans import graph, graph_queries, inputs, pipeline_queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_both_branches_of_every_step_are_taken(spark):
    """What the queries' inputs ask for: one or several drugs and patients, own or asked units, split or whole, lying or upright."""
    answers = graph_queries._summary_answers(spark, SF).cache()
    told = {s: [json.loads(r.payload) for r in answers.filter(F.col("step") == s).collect()] for s in ("drug_info", "patient_info", "individual_data_del", "param_type_align", "header_categorize")}
    for values in ([len(x) == 1 for x in told["drug_info"]], [len({tuple(y) for y in x}) == 1 for x in told["patient_info"]], [x["processed"] for x in told["individual_data_del"]],
                   ["col_name" in x for x in told["param_type_align"]], [list(x.values()).count("P value") > 1 for x in told["header_categorize"]], ["Unit" in x for x in told["header_categorize"]]):
        assert min(values.count(True), values.count(False)) >= 10
    deleted = told["individual_data_del"]
    assert any(x["processed"] and x.get("row_list") for x in deleted) and any(x["processed"] and x.get("col_list") for x in deleted)
    match = [json.loads(r.payload) for r in answers.filter("step = 'patient_match'").collect()]
    assert any(-1 in x for x in match)


def test_times_fit_their_rows(spark):
    n, h = ["N/A", "N/A"], ["1", "h"]
    cases = [([h], 3, [h] * 3), ([h, ["2", "h"]], 2, [h, ["2", "h"]]), ([h, ["2", "h"], n], 2, [h, ["2", "h"]]), ([h, ["2", "h"], h], 2, None), ([h, ["2", "h"]], 3, [h, ["2", "h"], n]), ([h, ["2", "h"]], 4, None)]
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "i int, d array<array<string>>, n int")
    got = [r.f for r in df.select("i", graph.fitted_times(F.col("d"), F.col("n")).alias("f")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_an_answer_of_the_wrong_length_is_an_error(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Group", "x"), (1, 0, 1, "Outcome", "5")], "doc_id int, row_idx int, col_idx int, header string, value string")
    steps = {"header_categorize": {"Group": "Row headers", "Outcome": "Outcome"}, "row_categorize": {"Group": {"x": "Exposure"}}}
    rows = [(1, s, None, json.dumps(v)) for s, v in steps.items()]
    value = ["5", "%", "Mean", "N/A", "N/A", "N/A", "N/A", "N/A"]
    schema = "doc_id int, step string, sub_id int, payload string"
    fine = graph.pe_study_outcome(cells, spark.createDataFrame([*rows, (1, "param_value", 0, json.dumps([value]))], schema), ["doc_id"]).collect()
    assert [(r["Exposure"], r["Outcome"], r["Parameter value"], r["Parameter unit"]) for r in fine] == [("x", "Outcome", "5", "%")]
    with pytest.raises(Exception, match="chunk"):
        graph.pe_study_outcome(cells, spark.createDataFrame([*rows, (1, "param_value", 0, json.dumps([value, value]))], schema), ["doc_id"]).collect()


@needs_tables
def test_inputs_of_cleanups_hit_each_branch(spark):
    told = inputs.individual(spark, SF)
    assert told.filter("patient_id = 'ERROR'").count() > 20
    rows = pipeline_queries.pipelines.assembled_rows("pk_specimen_summary", pipeline_queries._answers(spark, SF, "pk_specimen_summary"), ["doc_id"]).cache()
    clean = C.clean_specimen(rows, ["doc_id"], pipeline_queries.pipelines.OUTPUTS["pk_specimen_summary"])
    gone = rows.join(clean.select("doc_id", "row_idx"), ["doc_id", "row_idx"], "left_anti")
    assert gone.count() >= 20 and gone.groupBy("doc_id").count().filter("count > 1").count() == 0
    # a cell that isn't a number keeps its table as it is
    odd = clean.filter("`Sample N` = 'N/A'").select("doc_id").distinct()
    assert odd.count() >= 10 and clean.join(odd, "doc_id").filter("`Sample N` LIKE ' %'").count() > 0 and gone.join(odd, "doc_id").count() == 0


def test_specimen_rules(spark):
    cols = ["s", "n"]
    rows = [(1, 0, "a", "10"), (1, 1, "a", "30"), (1, 2, "b", "40"), (2, 0, "a", "1"), (2, 1, "a", "x"), (2, 2, "a", "1"), (3, 0, "a", "0"), (3, 1, "a", "0"), (4, 0, "a", " +5"), (4, 1, "a", "5"), (4, 2, "b", "1_0"), (5, 0, "a", "7")]
    df = spark.createDataFrame(rows, "t int, row_idx int, s string, n string")
    got = lambda **k: sorted((r.t, r.row_idx, r.n) for r in C.clean_specimen(df, ["t"], cols, "n", **k).collect())
    assert got() == [(1, 0, "10"), (1, 1, "30"), (2, 0, "1"), (2, 1, "x"), (2, 2, "1"), (3, 0, "0"), (3, 1, "0"), (4, 0, "5"), (4, 1, "5"), (5, 0, "7")]
    assert got(by_place=False) == [(1, 1, "30"), (2, 0, "1"), (2, 1, "x"), (2, 2, "1"), (3, 0, "0"), (4, 0, "5"), (5, 0, "7")]


def test_merged_order_and_containment_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(9)
    rows = [(t, k, *(r.choice(["N/A", "x", "y"]) for _ in range(4))) for t in range(40) for k in range(r.randint(1, 9))]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "t int, row_idx int, a string, b string, c string, d string").repartition(3)
    want_order, want_left = [], []
    for t in range(40):
        own = [x for x in rows if x[0] == t]
        groups = {}
        for x in own:
            groups.setdefault(x[2], []).append(x)
        out = []
        for key in sorted(groups, key=lambda k: (k == "N/A", k)):
            group, used, merged = groups[key], set(), []
            for i, j in itertools.combinations(range(len(group)), 2):
                if i in used or j in used:
                    continue
                if all(p == q or "N/A" in (p, q) for p, q in zip(group[i][2:], group[j][2:], strict=True)):
                    used |= {i, j}
                    merged.append(tuple(q if p == "N/A" else p for p, q in zip(group[i][2:], group[j][2:], strict=True)))
            out += merged + [x[2:] for k, x in enumerate(group) if k not in used]
        want_order += [(t, k, *x) for k, x in enumerate(out)]
        for x in own:
            covered = any(y[1] != x[1] and all(p == q or p == "N/A" for p, q in zip(x[2:], y[2:], strict=True)) and (x[2:] != y[2:] or y[1] > x[1]) for y in own)
            want_left += [] if covered else [x]
    assert sorted(map(tuple, C.merged_in_order(df, ["t"], ["a"], cols).collect())) == sorted(want_order)
    assert sorted(map(tuple, C.without_contained(df, ["t"], cols).collect())) == sorted(want_left)


def test_tables_are_turned_in_place_as_by_joins(spark):
    import random

    r = random.Random(4)
    schema = "t int, row_idx int, col_idx int, header string, value string"
    rows = []
    for t in range(60):
        wide = r.randint(1, 5)
        heads = [r.choice(["", " ", "a", "b", "Unnamed_3", None]) for _ in range(wide)]
        for k in range(r.randint(1, 5)):
            # some rows are shorter
            rows += [(t, k, c, heads[c], r.choice(["", " ", "x", "y", "Unnamed_1", None])) for c in range(wide if r.random() < 0.8 else r.randint(1, wide))]
    cells = spark.createDataFrame(rows, schema).repartition(3)
    told = graph.packed_tables(cells, ["t"]).select("t", graph.turned(F.struct("rows", "cols")).alias("x"))
    lines = told.select("t", F.explode("x.rows").alias("r"), F.col("x.cols").alias("cols")).select("t", "r", F.explode("cols").alias("c"))
    got = lines.select("t", "r.row_idx", "c.col_idx", "c.header", F.get("r.cells", F.col("c.old"))["value"].alias("value"))
    want = T.transpose_and_repair(cells, ["t"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
