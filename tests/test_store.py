from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tableweave.operators.store import CurationStore
from tableweave.streaming import ingest


def at(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k)


def rows(spark, items):
    return spark.createDataFrame([(p, c, t, at(k)) for p, c, t, k in items], "pmid string, curation_type string, md_table string, modified_time timestamp")


def shown(df):
    return sorted((r.pmid, r.curation_type, r.md_table) for r in df.collect())


def test_lookups_read_one_partition_and_push_their_key(spark, tmp_path):
    store = CurationStore(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, [(str(p), c, f"{p}{c}", p) for p in range(20) for c in ("a", "b")]))
    plan = store.get("3", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(curation_type" in plan and "EqualTo(pmid,3)" in plan
    assert shown(store.get("3", "a")) == [("3", "a", "3a")] and len(store.by_type("b").collect()) == 20 and len(store.by_pmid("7").collect()) == 2


def test_readers_dont_notice_compaction(spark, tmp_path):
    store = CurationStore(spark, str(tmp_path / "s"))
    store.upsert(rows(spark, [(str(p), "a", "old", p) for p in range(10)] + [("x", "b", "1", 0)]))
    store.upsert(rows(spark, [(str(p), "a", "new", 100 + p) for p in range(5)]))
    store._append(rows(spark, [("9", "a", None, 200)]).withColumn("deleted", F.lit(True)))
    before, open_ = shown(store.current()), store.current()
    base = store.compact()
    assert shown(store.current()) == before and shown(open_) == before
    # what comes later is read beside the base; an earlier change of a deleted record doesn't bring it back
    store.upsert(rows(spark, [("0", "a", "newest", 300), ("9", "a", "late", 150), ("x", "b", "0", -5)]))
    after = shown(store.current())
    assert ("0", "a", "newest") in after and not any(x[0] == "9" for x in after) and ("x", "b", "1") in after
    assert store._bases() == [base] and len(store.log().inputFiles()) < len(store._files()) + 10
    second = store.compact()
    assert shown(store.current()) == after
    store.vacuum()
    assert shown(store.current()) == after and store._bases() == [second] and not store._files()
    plan = store.get("0", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(curation_type" in plan and "EqualTo(pmid,0)" in plan
    # a base without its list isn't whole
    spark.createDataFrame([("1", "z")], "pmid string, md_table string").write.parquet(str(tmp_path / "s/_base/99999999-x/curation_type=a"))
    assert shown(store.current()) == after


def test_empty_store_compacts(spark, tmp_path):
    store = CurationStore(spark, str(tmp_path / "none"))
    assert store.count() == 0
    store.compact()
    store.vacuum()
    assert store.count() == 0


def test_progress_of_batches(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "in"))
    log = ingest.ProgressLog(spark, str(tmp_path / "log"))
    assert log.progress().count() == 0
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("q").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(log)
    got = log.progress().collect()
    assert len(got) == 3 and sorted(r.batch for r in got) == [0, 1, 2] and {r.name for r in got} == {"q"}
    assert [tuple(r) for r in ingest.totals(log.progress()).collect()] == [("q", 3, 100)]
