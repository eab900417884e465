"""Queries of the cleanup operators and of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.functions.scalars import has_digit
from tableweave.operators import cleanup as C
from tableweave.operators import positional, store
from tableweave.plans import inputs
from tableweave.plans.catalog import query

NAMES = C.Names()
COLUMNS = inputs.ASSEMBLED_COLUMNS
ALL = "doc_id, row_idx, " + ", ".join(COLUMNS)
_BASE = f"base AS ({inputs.ASSEMBLED})"
_NO_ERROR = "clean AS (SELECT * FROM base WHERE parameter_type <> 'ERROR')"

# The value rules in order, each a step over the one before.
_RULES = """
r1 AS (SELECT * REPLACE (CASE WHEN x THEN 'N/A' ELSE main_value END AS main_value, CASE WHEN x THEN 'N/A' ELSE statistics_type END AS statistics_type) FROM
  (SELECT *, (statistics_type = interval_type OR statistics_type = 'N/A') AND (main_value = lower_bound OR main_value = upper_bound) AS x FROM {source})),
r2 AS (SELECT * REPLACE (CASE WHEN lower_bound <> 'N/A' AND upper_bound <> 'N/A' AND NOT regexp_full_match(lower_bound, '\\s*N/A\\s*') AND NOT regexp_full_match(upper_bound, '\\s*N/A\\s*') AND contains(main_value, lower_bound) AND contains(main_value, upper_bound) THEN 'N/A' ELSE main_value END AS main_value) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN main_value = 'N/A' THEN 'N/A' ELSE statistics_type END AS statistics_type) FROM r2),
r4 AS (SELECT * REPLACE (CASE WHEN lower_bound = 'N/A' AND upper_bound = 'N/A' THEN 'N/A' WHEN lower_bound <> 'N/A' AND upper_bound <> 'N/A' THEN 'Range' ELSE interval_type END AS interval_type,
  CASE WHEN variation_value = 'N/A' THEN 'N/A' ELSE variation_type END AS variation_type) FROM r3)"""


def _norm(source: str, columns: list[str], spellings: bool = True) -> str:
    same = "WHEN {c} IN ('Standard Deviation (SD)', 's.d.', 'S.D.') THEN 'SD' " if spellings else ""
    one = "CASE WHEN regexp_full_match({c}, '\\s*') OR {c} IN ('n/a', 'unknown', 'Unknown', 'nan') THEN 'N/A' " + same + "WHEN {c} = ',' THEN ' ' ELSE {c} END AS {c}"
    return f"SELECT * REPLACE ({', '.join(one.format(c=c) for c in columns)}) FROM {source}"


_DEDUP = f"SELECT * FROM {{source}} QUALIFY row_number() OVER (PARTITION BY doc_id, {', '.join(COLUMNS)} ORDER BY row_idx) = 1"
_SPLIT = """
s1 AS (SELECT *, regexp_extract_all(lower_bound, '-?[0-9]+\\.[0-9]+') AS p, regexp_extract_all(upper_bound, '-?[0-9]+\\.[0-9]+') AS q FROM {source}),
s2 AS (SELECT * EXCLUDE (p, q, f) REPLACE (coalesce(f[1], lower_bound) AS lower_bound, coalesce(f[2], upper_bound) AS upper_bound) FROM
  (SELECT *, CASE WHEN upper_bound = 'N/A' AND len(p) = 2 THEN p WHEN lower_bound = 'N/A' AND len(q) = 2 THEN q WHEN lower_bound = upper_bound AND len(q) = 2 THEN q END AS f FROM s1))"""
_COVERED = " AND ".join(f"(i.{c} = j.{c} OR i.{c} = 'N/A')" for c in COLUMNS)
_DIFFER = " OR ".join(f"i.{c} <> j.{c}" for c in COLUMNS)
_CONTAIN = f"SELECT {ALL} FROM {{source}} i WHERE NOT EXISTS (SELECT 1 FROM {{source}} j WHERE i.doc_id = j.doc_id AND i.row_idx <> j.row_idx AND {_COVERED} AND ({_DIFFER} OR j.row_idx > i.row_idx))"


@query(
    f"WITH {_BASE}, {_NO_ERROR}, {_RULES.format(source='clean')}, n AS ({_norm('r4', COLUMNS)}), "
    "d AS (SELECT * FROM n WHERE regexp_matches(main_value || '|' || variation_type || '|' || lower_bound || '|' || upper_bound, '[0-9]')), "
    f"u AS (SELECT * FROM ({_DEDUP.format(source='d')}) WHERE subject_n <> main_value), {_SPLIT.format(source='u')} {_CONTAIN.format(source='s2')}"
)
def row_cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_summary(inputs.assembled(spark, sf_dir), ["doc_id"], NAMES, COLUMNS).select("doc_id", "row_idx", *COLUMNS)


_I = inputs.INDIVIDUAL_COLUMNS
_IBASE = f"base AS ({inputs.INDIVIDUAL})"
_UNITS = ", ".join(f"'{u}'" for u in C.LONG_UNITS)


@query(
    f"""WITH {_IBASE},
a AS (SELECT * REPLACE (CASE WHEN time_unit IN ({_UNITS}) THEN 'N/A' ELSE time_value END AS time_value) FROM base WHERE 'ERROR' NOT IN ({', '.join(_I)})),
b AS (SELECT * REPLACE (CASE WHEN time_value = 'N/A' THEN 'N/A' ELSE time_unit END AS time_unit) FROM a),
c AS (SELECT * REPLACE (CASE WHEN time_unit = 'N/A' THEN 'N/A' ELSE time_value END AS time_value) FROM b),
d AS (SELECT * REPLACE (CASE WHEN parameter_value = 'N/A' THEN 'N/A' ELSE parameter_type END AS parameter_type, CASE WHEN parameter_value = 'N/A' THEN 'N/A' ELSE parameter_unit END AS parameter_unit) FROM c),
e AS (SELECT * REPLACE (CASE WHEN parameter_type IN ('Cmax', 'Tmax', 'Cavg') THEN 'N/A' ELSE time_value END AS time_value) FROM d),
f AS (SELECT * REPLACE (CASE WHEN parameter_value IN ('Cmax', 'Tmax', 'Cavg') THEN 'N/A' ELSE time_unit END AS time_unit) FROM e),
n AS ({_norm('f', _I, False)})
SELECT doc_id, row_idx, {', '.join(_I)} FROM n WHERE parameter_value <> 'N/A' QUALIFY row_number() OVER (PARTITION BY doc_id, {', '.join(_I)} ORDER BY row_idx) = 1"""
)
def row_cleanup_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.individual(spark, sf_dir)
    return C.clean_individual(df, ["doc_id"], _I, "time_value", "time_unit", "parameter_value", "parameter_type", "parameter_unit").select("doc_id", "row_idx", *_I)


# Samples of each order's lines: whole numbers, or with one that is none; equal elsewhere within a ship mode.
_SAMPLES = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS row_idx, CAST(l_suppkey % 2 AS STRING) AS specimen,
  CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN '3.0' WHEN l_linenumber = 1 THEN ' 0' || CAST(l_orderkey % 4 AS STRING) ELSE CAST(l_partkey % 4 AS STRING) END AS sample_n
FROM lineitem
"""
_SUMS = r"""v AS (SELECT *, CASE WHEN regexp_full_match(sample_n, '\s*[+-]?[0-9]+\s*') THEN CAST(trim(sample_n) AS BIGINT) END AS v FROM base),
w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) = count(v) OVER (PARTITION BY doc_id) AS fine, sum(v) OVER (PARTITION BY doc_id) AS total FROM v),
x AS (SELECT *, min(CASE WHEN fine AND total - v = v AND v <> 0 THEN row_idx END) OVER (PARTITION BY doc_id) AS gone FROM w),
s AS (SELECT doc_id, row_idx, specimen, CASE WHEN fine THEN CAST(v AS STRING) ELSE sample_n END AS sample_n, fine, v FROM x WHERE row_idx IS DISTINCT FROM gone)"""


@query(
    f"""WITH {_IBASE}, f AS (SELECT *, min(row_idx) OVER (PARTITION BY doc_id, patient_id) AS first FROM base)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first, row_idx) - 1 AS INT) AS row_idx, {', '.join(_I)} FROM f"""
)
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_first_appearance(inputs.individual(spark, sf_dir), ["doc_id"], "patient_id").select("doc_id", "row_idx", *_I)


@query(f"WITH base AS ({_SAMPLES}), {_SUMS} SELECT doc_id, row_idx, specimen, sample_n FROM s")
def sum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_specimen(inputs.from_sql(spark, sf_dir, _SAMPLES, "lineitem"), ["doc_id"], ["specimen", "sample_n"], "sample_n")


@query(
    f"""WITH base AS ({_SAMPLES}), {_SUMS}
SELECT doc_id, row_idx, specimen, sample_n FROM s QUALIFY NOT fine OR row_number() OVER (PARTITION BY doc_id, specimen, fine ORDER BY v DESC, row_idx) = 1"""
)
def largest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_specimen(inputs.from_sql(spark, sf_dir, _SAMPLES, "lineitem"), ["doc_id"], ["specimen", "sample_n"], "sample_n", by_place=False)


@query(f"WITH {_BASE}, {_RULES.format(source='base')} SELECT {ALL} FROM r4")
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rewritten(inputs.assembled(spark, sf_dir), C.value_rules(NAMES)).select("doc_id", "row_idx", *COLUMNS)


@query(f"WITH {_BASE} SELECT {ALL} FROM ({_norm('base', COLUMNS)})")
def normalized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalized(inputs.assembled(spark, sf_dir), COLUMNS).select("doc_id", "row_idx", *COLUMNS)


@query(f"WITH {_BASE} SELECT doc_id, row_idx FROM base WHERE parameter_type <> 'ERROR' AND regexp_matches(main_value || '|' || lower_bound, '[0-9]')")
def numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_numbers(C.without_errors(inputs.assembled(spark, sf_dir), COLUMNS), ["main_value", "lower_bound"]).select("doc_id", "row_idx")


@query(f"WITH {_BASE} SELECT {ALL} FROM ({_DEDUP.format(source='base')})")
def first_of_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of_equal(inputs.assembled(spark, sf_dir), ["doc_id"], COLUMNS).select("doc_id", "row_idx", *COLUMNS)


@query(f"WITH {_BASE} {_CONTAIN.format(source='base')}")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without_contained(inputs.assembled(spark, sf_dir), ["doc_id"], COLUMNS).select("doc_id", "row_idx", *COLUMNS)


@query(f"WITH {_BASE}, {_SPLIT.format(source='base')} SELECT doc_id, row_idx, lower_bound, upper_bound FROM s2")
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_ranges(inputs.assembled(spark, sf_dir), NAMES).select("doc_id", "row_idx", "lower_bound", "upper_bound")


# Two rows a group, medians with and without bounds of their own, ranges in either row.
_MEDIANS = """
SELECT o_custkey AS doc_id, CAST(o_orderkey * 2 AS BIGINT) AS row_idx, CAST(o_orderkey AS STRING) AS drug_name, CASE WHEN o_orderkey % 3 = 0 THEN 'Mean' ELSE 'Median' END AS statistics_type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Range' ELSE 'N/A' END AS interval_type, CASE WHEN o_orderkey % 2 = 0 THEN '4' ELSE 'N/A' END AS lower_bound, 'N/A' AS upper_bound FROM orders
UNION ALL
SELECT o_custkey, CAST(o_orderkey * 2 + 1 AS BIGINT), CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey END AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN 'Median' ELSE 'Mean' END,
  CASE WHEN o_orderkey % 5 = 0 THEN '95% CI' ELSE 'Range' END, '1', '9' FROM (SELECT * FROM orders)
"""
_GROUP = "PARTITION BY doc_id, drug_name"
_MOVED = """SELECT * EXCLUDE (fits, l, u) REPLACE (CASE WHEN fits THEN CASE WHEN statistics_type = 'Median' THEN 'Range' ELSE 'N/A' END ELSE interval_type END AS interval_type,
  CASE WHEN fits THEN CASE WHEN statistics_type = 'Median' THEN l ELSE 'N/A' END ELSE lower_bound END AS lower_bound, CASE WHEN fits THEN CASE WHEN statistics_type = 'Median' THEN u ELSE 'N/A' END ELSE upper_bound END AS upper_bound)
FROM (SELECT *, count(*) OVER ({g}) = 2 AND count(*) FILTER (WHERE statistics_type = 'Median') OVER ({g}) = 1 AND count(*) FILTER (WHERE statistics_type <> 'Median' AND interval_type = 'Range') OVER ({g}) = 1 AS fits,
  max(CASE WHEN statistics_type <> 'Median' AND interval_type = 'Range' THEN lower_bound END) OVER ({g}) AS l, max(CASE WHEN statistics_type <> 'Median' AND interval_type = 'Range' THEN upper_bound END) OVER ({g}) AS u FROM {source})"""


@query(f"WITH base AS ({_MEDIANS}) {_MOVED.format(g=_GROUP, source='base')}")
def range_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.range_to_median(inputs.from_sql(spark, sf_dir, _MEDIANS, "orders"), ["doc_id"], NAMES, ["drug_name"])


# The whole cleanup in order. Identities have two rows at most, so that SQL can say what merging pairs gives.
_ARMS = f"SELECT doc_id, row_idx, CAST(floor(row_idx / 2) AS STRING) AS drug_name, {', '.join(COLUMNS[1:])} FROM ({inputs.ASSEMBLED})"
_AGREE = " AND ".join(f"count(DISTINCT nullif({c}, 'N/A')) OVER (PARTITION BY doc_id, drug_name) <= 1" for c in COLUMNS)
_FILLED = ", ".join(f"coalesce(max(nullif({c}, 'N/A')), 'N/A') AS {c}" for c in COLUMNS)
_IDENTITY = "PARTITION BY doc_id, drug_name"


@query(
    f"WITH base AS ({_ARMS.replace('CAST(floor(row_idx / 2) AS STRING)', 'CAST(row_idx // 2 AS STRING)')}), {_NO_ERROR}, {_RULES.format(source='clean')}, n AS ({_norm('r4', COLUMNS)}), "
    "d AS (SELECT * FROM n WHERE regexp_matches(main_value || '|' || variation_type || '|' || lower_bound || '|' || upper_bound, '[0-9]')), "
    f"c AS (SELECT *, count(*) OVER ({_IDENTITY}) = 2 AND {_AGREE} AS agree FROM d), "
    f"p AS (SELECT {ALL}, false AS merged FROM c WHERE NOT agree UNION ALL SELECT doc_id, min(row_idx) AS row_idx, {_FILLED}, true FROM c WHERE agree GROUP BY doc_id, c.drug_name), "
    f"m AS (SELECT * EXCLUDE (merged) REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY drug_name, merged DESC, row_idx) - 1 AS INT) AS row_idx) FROM p), "
    f"u AS (SELECT * FROM ({_DEDUP.format(source='m')}) WHERE subject_n <> main_value), {_SPLIT.format(source='u')}, k AS ({_CONTAIN.format(source='s2')}) {_MOVED.format(g=_IDENTITY, source='k')}"
)
def row_cleanup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.Names(identity=["drug_name"])
    return C.clean_summary(inputs.from_sql(spark, sf_dir, _ARMS, "lineitem"), ["doc_id"], names, COLUMNS).select("doc_id", "row_idx", *COLUMNS)


# Each order as two rows, one with the price and one with the date, which complete each other unless the price is low.
_PAIRS = """
SELECT o_custkey AS doc_id, CAST(o_orderkey * 2 AS BIGINT) AS row_idx, CAST(o_orderkey AS STRING) AS name, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS price, 'N/A' AS status FROM orders
UNION ALL
SELECT o_custkey, CAST(o_orderkey * 2 + 1 AS BIGINT), CAST(o_orderkey AS STRING), CASE WHEN o_totalprice < 50000 THEN 'low' ELSE 'N/A' END, o_orderstatus FROM (SELECT * FROM orders)
"""


@query(
    f"""WITH base AS ({_PAIRS}), g AS (SELECT *, count(DISTINCT nullif(price, 'N/A')) OVER (PARTITION BY doc_id, name) AS prices FROM base)
SELECT doc_id, row_idx, name, price, status FROM g WHERE prices > 1 UNION ALL
SELECT doc_id, min(row_idx), name, max(nullif(price, 'N/A')), max(nullif(status, 'N/A')) FROM g WHERE prices <= 1 GROUP BY doc_id, name"""
)
def merged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.from_sql(spark, sf_dir, _PAIRS, "orders")
    return C.merged_pairs(df, ["doc_id"], ["name"], ["name", "price", "status"])


# The same with names that are missing now and then, in groups of two rows at most.
_NAMED = "CASE WHEN o_orderkey % 5 = 0 AND o_orderkey = first THEN 'N/A' ELSE CAST(o_orderkey % 1000 AS STRING) || '-' || CAST(o_orderkey AS STRING) END AS name"
_ORDER_PAIRS = f"""
SELECT o_custkey AS doc_id, CAST(o_orderkey * 2 AS BIGINT) AS row_idx, {_NAMED}, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS price, 'N/A' AS status
  FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) a
UNION ALL
SELECT o_custkey, CAST(o_orderkey * 2 + 1 AS BIGINT), {_NAMED}, CASE WHEN o_totalprice < 50000 THEN 'low' ELSE 'N/A' END, o_orderstatus
  FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) b
"""


@query(
    f"""WITH base AS ({_ORDER_PAIRS}), g AS (SELECT *, count(DISTINCT nullif(price, 'N/A')) OVER (PARTITION BY doc_id, name) AS prices FROM base),
m AS (SELECT doc_id, row_idx, name, price, status, false AS merged FROM g WHERE prices > 1 UNION ALL
  SELECT doc_id, min(row_idx), name, max(nullif(price, 'N/A')), max(nullif(status, 'N/A')), true FROM g WHERE prices <= 1 GROUP BY doc_id, name)
SELECT * EXCLUDE (merged) REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY name = 'N/A', name, merged DESC, row_idx) - 1 AS row_idx) FROM m"""
)
def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.from_sql(spark, sf_dir, _ORDER_PAIRS, "orders")
    return C.merged_in_order(df, ["doc_id"], ["name"], ["name", "price", "status"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE try_cast(l_returnflag AS DOUBLE) IS NOT NULL OR regexp_matches(l_linestatus, '[0-9]') OR l_partkey % 2 = 0")
def parsed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.load(spark, sf_dir, "lineitem")
    keep = F.col("l_returnflag").try_cast("double").isNotNull() | has_digit(F.col("l_linestatus")) | (F.col("l_partkey") % 2 == 0)
    return df.filter(keep).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- the store: events as a log of updates


@query("SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return store.latest(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_values(inputs.load(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0)")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.load(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return store.new_only(inputs.load(spark, sf_dir, "customer").select("c_custkey", "c_name"), stored, ["c_custkey"])


@query(
    """SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'skipped' WHEN c_acctbal < 0 THEN 'failed' ELSE 'inserted' END AS status, count(*) AS n FROM customer GROUP BY 1"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.ingest_report(inputs.load(spark, sf_dir, "customer"), stored, ["c_custkey"], F.col("c_acctbal") < 0)


@query("SELECT event_id, user_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'click'")
def records_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return store.latest(log, ["user_id", "event_type"], ["ts", "event_id"]).filter("event_type = 'click'").select("event_id", "user_id")


@query(
    """SELECT CAST(user_id AS STRING) AS pmid, event_type AS curation_type, CAST(event_id AS STRING) AS md_table FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) = 1 AND event_id % 7 <> 0"""
)
def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three parts to a store that is compacted after the first two; every seventh is a deletion."""
    from tableweave.plans.materialize import scratch_path

    events = inputs.load(spark, sf_dir, "events")
    # parts are years apart, and within one a microsecond tells events of one time
    when = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") + (F.col("event_id") % 3) * 10**16).cast("long"))
    rows = events.select(
        F.col("user_id").cast("string").alias("pmid"), F.col("event_type").alias("curation_type"), F.col("event_id").cast("string").alias("md_table"), when.alias("modified_time"),
        (F.col("event_id") % 7 == 0).alias("deleted"), (F.col("event_id") % 3).alias("part"),
    )
    kept = store.CurationStore(spark, scratch_path(spark, "curation"))
    for part in range(3):
        kept.upsert(rows.filter(F.col("part") == part).drop("part"))
        if part == 1:
            kept.compact()
    return kept.current().select("pmid", "curation_type", "md_table")


@query("SELECT role, sum(length(text)) AS total, sum(length(text) // 2) AS prompt, sum(length(text) - length(text) // 2) AS completion FROM conversations GROUP BY role")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length(F.coalesce("text", F.lit("")))
    usage = F.struct(n.alias("total"), F.floor(n / 2).alias("prompt"), (n - F.floor(n / 2)).alias("completion"))
    return store.total_usage(inputs.load(spark, sf_dir, "conversations").withColumn("token_usage", usage), ["role"])


@query("SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into the store, and the state that its log gives."""
    from tableweave.plans.materialize import scratch_path
    from tableweave.streaming.ingest import upsert_latest

    schema = inputs.load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "ts", "user_id", "event_type")
    path = scratch_path(spark, "stream")
    upsert_latest(stream, path, scratch_path(spark, "stream-state"), ["user_id"], ["ts", "event_id"]).awaitTermination()
    log = spark.read.parquet(path).select("event_id", "ts", "user_id", "event_type")
    return store.latest(log, ["user_id"], ["ts", "event_id"])


@query("SELECT 'events' AS name, count(*) AS rows, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several batches, the rows that a listener counted for them, and what they were worth."""
    from tableweave.plans.materialize import scratch_path
    from tableweave.streaming.ingest import ProgressLog, totals

    events = inputs.load(spark, sf_dir, "events")
    source, sink = scratch_path(spark, "progress-in"), scratch_path(spark, "progress-out")
    events.select("event_id", "value").repartition(4, "event_id").write.parquet(source)
    log = ProgressLog(spark, scratch_path(spark, "progress"))
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("event_id long, value double").option("maxFilesPerTrigger", 1).parquet(source)
        told = stream.writeStream.queryName("events").option("checkpointLocation", scratch_path(spark, "progress-state")).trigger(availableNow=True).format("parquet").start(sink)
        told.awaitTermination()
        # listeners are told on a thread of their own
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(log)
    return totals(log.progress()).select("name", "rows").join(spark.read.parquet(sink).agg(F.sum(F.floor("value").cast("long")).alias("total")))


@query(
    inputs.over_orders(
    """WITH p AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'fixed ' || n_name END AS fix FROM nation)
SELECT n.n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n.n_regionkey ORDER BY n.n_nationkey) - 1 AS INT) AS row_idx, coalesce(fix, n_name) AS n_name FROM nation n JOIN p USING (n_nationkey)"""
    )
)
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positional.numbered(inputs.nation(spark, sf_dir).withColumnRenamed("n_regionkey", "doc_id"), ["doc_id"], ["n_nationkey"])
    fixes = rows.filter("n_nationkey % 4 = 0").select("doc_id", "row_idx", F.lit("n_name").alias("column"), F.concat(F.lit("fixed "), "n_name").alias("new_value"))
    return positional.patched(rows, fixes, ["doc_id"], ["n_name"]).select("doc_id", "row_idx", "n_name")
