from __future__ import annotations

from pyspark.sql import functions as F

from tableweave.functions.similarity import is_abbreviation
from tableweave.operators import cleanup, evaluate, positional, sequence
from tableweave.plans import inputs, materialize
from tableweave.sources import files


def test_runs_nulls_and_orders(spark):
    rows = [(1, k, v) for k, v in enumerate([None, None, "a", "a", None, "b", "a"])] + [(2, 0, None), (3, 0, "z")]
    df = spark.createDataFrame(rows, "t int, k int, v string").repartition(3)
    assert sorted((r.t, r.k) for r in sequence.adjacent_distinct(df, ["t"], ["k"], ["v"]).collect()) == [(1, 0), (1, 2), (1, 4), (1, 5), (1, 6), (2, 0), (3, 0)]
    assert sorted((r.t, r.k, r.h) for r in sequence.carried(df.filter("t = 1"), ["t"], ["k"], F.col("v"), "h").filter("k > 1").collect()) == [(1, 2, "a"), (1, 3, "a"), (1, 4, "a"), (1, 5, "b"), (1, 6, "a")]
    assert sorted((r.t, r.x) for r in sequence.joined(df, ["t"], ["k"], "v", "x", "|", distinct=True).collect()) == [(1, "a|b"), (2, ""), (3, "z")]


def test_first_appearance(spark):
    rows = [(1, k, p) for k, p in enumerate(["b", "a", "b", None, "a", None])]
    df = spark.createDataFrame(rows, "t int, row_idx int, p string").repartition(2)
    assert [r.p for r in cleanup.by_first_appearance(df, ["t"], "p").orderBy("row_idx").collect()] == ["b", "b", "a", "a", None, None]


def test_number_column_and_markdown_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "x"), (1, 4, "y")], "t int, PMID int, v string")
    assert [tuple(r) for r in positional.number_column(df, ["t"], ["PMID"], "pmid").orderBy("no").collect()] == [(1, 0, 4, "y"), (1, 1, 5, "x")]
    assert positional.number_column(df, ["t"], ["PMID"], "other").columns == ["t", "no", "v"]
    tables = spark.createDataFrame([("t1", '| a | b |\n| --- | --- |\n| 1, 2 | say "x" |\n| 3 | 4 |')], "key string, markdown string")
    files.write_markdown_as_csv(tables, str(tmp_path / "csv"), "key")
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["a,b", '"1, 2","say ""x"""', "3,4"]


def test_long_abbreviations(spark):
    n = 100_000
    rows = [("ab" * n, "ab" * n, True), ("ab" * n, "x" + "ab" * n, True), ("ba" * n, "ab" * n, False), ("", " ", True), ("", "a", False), ("1", "a", False), ("N.O.", "Nitric Oxide", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", is_abbreviation(F.col("a"), F.col("b"))).collect())


def test_scores_by_vectors(spark):
    vectors = spark.createDataFrame([("heart", [1.0, 0.0]), ("cardiac", [0.9, 0.1]), ("liver", [0.0, 1.0])], "text string, vector array<double>")
    a = spark.createDataFrame([(1, 0, "1", "Heart"), (1, 1, "2", "liver"), (2, 0, "1", "unknown")], "t int, row_idx int, v string, name string")
    b = spark.createDataFrame([(1, 0, "1", "'cardiac'"), (1, 1, "2", "heart"), (2, 0, "1", "heart")], "t int, row_idx int, v string, name string")
    got = evaluate.score_tables_by_vectors(a, b, ["t"], ["v"], [("name", False, 1.0)], vectors)
    assert sorted((r.t, r.score) for r in got.collect()) == [(1, 50), (2, 0)]


def _names(spark, tables, shift):
    return spark.range(tables * 10).selectExpr("CAST(id DIV 10 AS INT) AS t", "CAST(id % 10 AS INT) AS row_idx", "CAST(id AS STRING) AS v", f"chr(CAST(97 + (id * 7 + {shift}) % 20 AS INT)) AS name")


def test_pairs_of_texts_are_not_written_for_each_table(spark):
    vectors = spark.range(20).selectExpr("chr(CAST(97 + id AS INT)) AS text", "array(CAST(id AS DOUBLE), 1.0D) AS vector")
    for tables in (2, 40):
        a, b = (inputs.dealt_out(_names(spark, tables, shift), ["t"]) for shift in (0, 3))
        with materialize.recorded() as paths:
            told = evaluate.looked_up_similarities(a, b, ["t"], ["v", "name"], vectors)
        # texts with their vectors, and pairs of these with their ratings, however many tables there are
        assert all(spark.read.parquet(p).count() <= 20 * 20 // 2 for p in paths)
        # tables stay where they were dealt out
        assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 2
        assert told.count() == tables


def test_looked_up_similarities_of_pairs_that_meet_twice(spark, monkeypatch):
    rows = "t int, row_idx int, v string, name string"
    a = spark.createDataFrame([(1, 0, "x", "Y"), (1, 1, "y", "x"), (1, 2, "", None), (2, 0, "x", "none"), (3, 0, "x", "y"), (None, 0, "x", "x")], rows)
    b = spark.createDataFrame([(1, 0, "y", "'x'"), (1, 1, "x", "y"), (1, 2, "zero", ""), (2, 0, "none", "x"), (4, 0, "x", "y"), (None, 0, "y", "y")], rows)
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("Y", [3.0, 4.0]), (" y", [9.0, 9.0]), ("zero", [0.0, 0.0]), ("", [1.0, 1.0]), (None, [1.0, 1.0])], "text string, vector array<double>")
    want = [(1, {"x\u001fy": 0.6})]
    got = lambda: [(r.t, r[evaluate.SIMILARITIES]) for r in evaluate.looked_up_similarities(a, b, ["t"], ["v", "name"], vectors).collect()]
    assert got() == want
    monkeypatch.setattr(evaluate, "hinted_by_size", lambda df, size: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
