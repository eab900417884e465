from __future__ import annotations

import hashlib
import re

from tableweave.llm import exact_dedup as E


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if lowered(u) == lowered(t)]
        out.append((i, max(same), len(same), i == max(same), hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    texts = [None, "", "a", "A", "É", "é", "x" * 300 + "1", "x" * 300 + "2", "X" * 300 + "1", "ab" * 60_000, "AB" * 60_000, "same length", "SAME LENGTh", "other text."]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(docs, digest_all=True).collect())
    assert got == brute(rows)
    decided = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(docs).collect())
    assert decided == [x[:4] for x in brute(rows)]


def test_repeated_rows_nulls_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, keep_id string, __n int, __digest int"
    assert E.exact_dedup(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a", "k", 1, 1), (1, "a", "k", 1, 1), (None, "a", "k", 2, 2), (None, "b", "k", 3, 3), (None, "b", "k", 3, 3)], schema)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in E.exact_dedup(docs).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    kept = E.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a"), ("None", "b")]


def test_no_text_is_shuffled_however_many_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    rows = [(k, f"text {k // 3}") for k in range(60)] + [(100 + k, f"lone {k}" * k) for k in range(20)]
    df = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=True)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())
    assert got == brute(rows)
    # what is joined, and so may be shuffled, is read from a table of ids and digests
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "text:string" not in plan and "__digest:binary" in plan
    kept = E.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in brute(rows) if x[3]]


def test_marks_never_miss(spark):
    from pyspark.sql import functions as F

    from tableweave.llm.marks import marked, marks_of

    df = spark.range(200_000).withColumn("h", F.xxhash64("id"))
    told = marked(df, marks_of(df.filter("id % 100 = 0"), F.col("h"), "t"), F.col("h"), "yes")
    r = told.agg(F.count_if(F.expr("yes AND id % 100 = 0")).alias("hit"), F.count_if(F.expr("yes AND id % 100 <> 0")).alias("more")).first()
    assert r.hit == 2000 and r.more < 100
