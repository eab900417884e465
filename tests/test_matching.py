"""How often candidates are compared, and that short cuts of the comparisons change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableweave.functions import similarity as M
from tableweave.operators import evaluate


def test_candidates_are_compared_once_for_each_anchor(spark):
    table = spark.createDataFrame([(1, 0, "alpha", "1"), (1, 1, "beta", "2")], "doc_id int, row_idx int, name string, value string")
    plan = evaluate.score_tables(table, table, ["doc_id"], ["name"], [("value", True, 1.0)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(lambda") + plan.count("filter(") < 4
    assert [r.score for r in evaluate.score_tables(table, table, ["doc_id"], ["name"], [("value", True, 1.0)]).collect()] == [100]


def test_short_cuts_change_no_similarity(spark):
    texts = ["", " ", "a", "ab", "ba", "A.B.", "alpha beta", "ab 1", "Ab 1 ", "1", "1-2", "ab 2", "b-a", "zz", "azb", "é", "a1b2"]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    general = lambda a, b: M.exact_similarity(a, b)
    told = pairs.select("a", "b", M.text_similarity(F.col("a"), F.col("b")).alias("x"), M.text_similarity(F.col("a"), F.col("b"), general).alias("y"), M.is_abbreviation(F.col("a"), F.col("b")).alias("short"))
    for r in told.collect():
        assert r.x == r.y, r
        x, y = r.a.strip(" ").lower(), r.b.strip(" ").lower()
        short, long = (y, x) if len(x) >= len(y) else (x, y)
        letters, rest = [c for c in short if "a" <= c <= "z"], iter(long)
        want = (not x and not y) or (bool(x and y and letters) and all(c in rest for c in letters))
        assert r.short == want, r
