from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tableweave.llm import exact_dedup, near_dedup, packing, pii_surrogates, quality_rules, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")


def test_thirteen_operators():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(docs).collect()}
    one = corpus_pipeline.quality(spark, docs, SF).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {k for k, v in told.items() if v}
    two = corpus_pipeline.exact(spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(one).collect() if r.kept}
    three = corpus_pipeline.near(spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in near_dedup.near_duplicates(two).collect() if r.kept}
    four = corpus_pipeline.private(spark, three, SF).cache()
    want = {r.doc_id: r.text for r in pii_surrogates.replace_personal_data(three, queries.SURROGATE_KEY).collect()}
    assert four.columns == docs.columns and {r.doc_id: r.text for r in four.collect()} == want
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == set(want)
    assert sum(r.length for r in last) == sum(r.length for r in packing.pack(four, queries.tokenizer_path(queries.TOKENIZER)).collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, nulls in any column, empty texts, repeated rows and ids; each stage on what the one before wrote."""
    import os

    long = " ".join(f"word{k}" for k in range(300))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long.upper(), None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, long + " more", "en", "s", 1)]
    rows += [(None, "other " + long[::-1], None, "t", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("none", []), ("odd", rows)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, folder)
            if k < 4:
                assert out.columns == docs.columns
                seen.append(out.schema[0].metadata[corpus_pipeline.SCRATCH])
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        whole = corpus_pipeline.run(spark, folder).collect()
        key = lambda r: (str(r.doc_id), r.piece, r.length, r.ids_crc32)
        assert sorted(map(key, docs.collect())) == sorted(map(key, whole))
        assert {r.doc_id for r in whole} == ({None, 2, 4} if some else set()) or {r.doc_id for r in whole} == ({None, 2} if some else set())
        # what earlier stages left has been given back, and no stage knew of another but by its input
        assert not any(os.path.exists(p.removeprefix("file://")) for paths in seen[:3] for p in paths)


def test_two_runs_over_one_folder_dont_meet(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = corpus_pipeline.quality(spark, docs, SF), corpus_pipeline.quality(spark, docs, SF)
    third = corpus_pipeline.exact(spark, one, SF)
    assert two.count() == one.count() > third.count() > 0
