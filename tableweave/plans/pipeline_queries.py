"""The ten pipelines over answers recorded for each customer's orders, with SQL for their output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.operators import evaluate
from tableweave.plans import batch, inputs, pipelines
from tableweave.plans.catalog import query

# What a step answers for an order, in SQL that Spark and the oracle both read; other columns: their name and a digit.
_CELLS = {
    "Parameter value": "CAST(o_orderkey AS STRING)",
    "Parameter type": "'type ' || CAST(o_orderkey AS STRING)",
    "Characteristic value": "CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE CAST(o_orderkey AS STRING) END",
    "Parameter statistic": "'Mean'",
    "Variation type": "CASE WHEN o_orderkey % 4 = 0 THEN 'S.D.' ELSE 'SE' END",
    "Variation value": "CASE WHEN o_orderkey % 4 = 0 THEN '2' ELSE 'N/A' END",
    "Interval type": "'IQR'",
    "Lower bound": "CASE WHEN o_orderkey % 2 = 0 THEN 'N/A' ELSE '1' END",
    "Upper bound": "CASE WHEN o_orderkey % 2 = 0 THEN 'N/A' ELSE '9' END",
    "Time unit": "CASE WHEN o_orderkey % 5 = 0 THEN 'weeks' ELSE 'h' END",
    "P value": "CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE '0.05' END",
    # of every third customer the last order has the sum of the others; of every fifth the first order has no number
    "Sample N": "CASE WHEN o_custkey % 5 = 0 AND o_orderkey = o_first THEN 'N/A' WHEN o_custkey % 3 = 0 AND o_orderkey = o_last THEN CAST(o_rest AS STRING) ELSE ' ' || CAST(o_orderkey % 5 + 1 AS STRING) END",
}
# Orders with each customer's first and last one, and the samples of all but the last.
_ORDERS = """
SELECT *, sum(CASE WHEN o_orderkey = o_last THEN 0 ELSE o_orderkey % 5 + 1 END) OVER (PARTITION BY o_custkey) AS o_rest FROM (
  SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS o_first, max(o_orderkey) OVER (PARTITION BY o_custkey) AS o_last FROM orders)
"""


def _cell(column: str) -> str:
    return _CELLS.get(column, f"'{column} ' || CAST(o_orderkey % 7 AS STRING)")


def _answers(spark: SparkSession, sf_dir: str, pipeline: str) -> DataFrame:
    """``doc_id, step, payload``. Customers of even number have lookups of one row, the others of three, and matches beyond them."""
    orders = inputs.from_sql(spark, sf_dir, _ORDERS, "orders").withColumn("doc_id", F.col("o_custkey"))
    direct, lookups = pipelines.STEPS[pipeline]
    in_order = lambda c: F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", c.alias("x")))), lambda s: s["x"]))
    answers = {step: in_order(F.array(*[F.expr(_cell(c)) for c in columns])) for step, columns in direct.items()}
    for step, (match, columns) in lookups.items():
        table = F.array(*[F.array(*[F.lit(f"{c} {r}") for c in columns]) for r in range(3)])
        answers[step] = F.to_json(F.slice(table, F.lit(1), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(3)))
        answers[match] = in_order((F.col("o_orderkey") % 4).cast("int"))
    told = orders.groupBy("doc_id").agg(*[v.alias(k) for k, v in answers.items()])
    return told.select("doc_id", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in answers]), F.array(*[F.col(k) for k in answers]))).alias("step", "payload"))


def _sql(pipeline: str) -> str:
    direct, lookups = pipelines.STEPS[pipeline]
    cells = {c: _cell(c) for columns in direct.values() for c in columns}
    for _, columns in lookups.values():
        cells |= {c: f"CASE WHEN o_custkey % 2 = 0 THEN '{c} 0' WHEN o_orderkey % 4 = 3 THEN 'ERROR' ELSE '{c} ' || CAST(o_orderkey % 4 AS STRING) END" for c in columns}
    columns = pipelines.OUTPUTS[pipeline]
    rows = ", ".join(f'{cells.get(c, "NULL")} AS "{c}"' for c in columns)
    base = f"SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, {rows} FROM ({_ORDERS})"
    if pipeline in ("pk_summary", "pe_study_outcome"):
        # values that hold both bounds go with their statistic; bounds make a range; spellings and words for missing
        held = """"Lower bound" <> 'N/A' AND contains("Parameter value", '1') AND contains("Parameter value", '9')"""
        swaps = f"""CASE WHEN {held} THEN 'N/A' ELSE "Parameter value" END AS "Parameter value", CASE WHEN {held} THEN 'N/A' ELSE "Parameter statistic" END AS "Parameter statistic",
          CASE WHEN "Lower bound" = 'N/A' THEN 'N/A' ELSE 'Range' END AS "Interval type", CASE WHEN "Variation value" = 'N/A' THEN 'N/A' ELSE 'SD' END AS "Variation type", CASE WHEN "P value" = 'unknown' THEN 'N/A' ELSE "P value" END AS "P value\""""
        told = f"SELECT * REPLACE ({swaps}) FROM ({base})"
        if pipeline == "pe_study_outcome":
            return told
        # rows come by what they are about, as merged ones do
        order = ", ".join(f"""\"{c}\" = 'N/A', \"{c}\"""" for c in pipelines.IDENTITY)
        return f"""SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}, row_idx) - 1 AS INT) AS row_idx) FROM ({told} WHERE "Specimen" <> 'ERROR')"""
    if pipeline == "pk_individual":
        gone = """"Time unit" = 'weeks'"""
        return f"""SELECT * REPLACE (CASE WHEN {gone} THEN 'N/A' ELSE "Time value" END AS "Time value", CASE WHEN {gone} THEN 'N/A' ELSE "Time unit" END AS "Time unit") FROM ({base}) WHERE 'ERROR' NOT IN ("Drug name", "Patient ID")"""
    if pipeline in ("pk_specimen_summary", "pk_specimen_individual"):
        return rf"""SELECT * EXCLUDE (v, fine, total, gone) REPLACE (CASE WHEN fine THEN CAST(v AS STRING) ELSE "Sample N" END AS "Sample N") FROM (
  SELECT *, min(CASE WHEN fine AND total - v = v AND v <> 0 THEN row_idx END) OVER (PARTITION BY doc_id) AS gone FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id) = count(v) OVER (PARTITION BY doc_id) AS fine, sum(v) OVER (PARTITION BY doc_id) AS total FROM (
  SELECT *, CASE WHEN regexp_full_match("Sample N", '\s*[+-]?[0-9]+\s*') THEN CAST(trim("Sample N") AS BIGINT) END AS v FROM ({base})))) WHERE row_idx IS DISTINCT FROM gone"""
    return f"SELECT * FROM ({base})" + (""" WHERE regexp_matches("Characteristic value", '[0-9]')""" if pipeline == "pk_population_individual" else "")


def _registered(pipeline: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pipelines.curated(pipeline, _answers(spark, sf_dir, pipeline), ["doc_id"])

    run.__name__ = f"pipeline_{pipeline}"
    query(_sql(pipeline))(run)


for _name in pipelines.OUTPUTS:
    _registered(_name)


@query(" UNION ALL ".join(f"SELECT '{p}' AS pipeline, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_sql(p)})" for p in ("pk_summary", "pe_study_outcome")))
def united_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["pk_summary", "pe_study_outcome"]
    answers = [_answers(spark, sf_dir, p).withColumn("pipeline", F.lit(p)) for p in names]
    rows = pipelines.curated_all(answers[0].unionByName(answers[1]), ["doc_id"], names)
    return rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


# Baselines of single patients' tables: a value for each order, other units now and then; regions' have no answers.
_BASELINES = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, CAST(o_orderkey AS STRING) AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE 'Parameter unit ' || CAST(o_orderkey % 7 AS STRING) END AS unit, 'h' AS time_unit
FROM orders
"""


@query(
    """WITH o AS (SELECT o_custkey AS doc_id, NOT (o_custkey % 2 = 1 AND o_orderkey % 4 = 3) AS kept, CAST(floor(10.0 * (CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) / 3.0) AS BIGINT) AS points FROM orders),
s AS (SELECT doc_id, count(*) FILTER (WHERE kept) AS less, count(*) AS more, sum(points) FILTER (WHERE kept) AS points FROM o GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN less > 0 THEN less END AS INT) AS less_rows, CAST(CASE WHEN less > 0 THEN more END AS INT) AS more_rows,
  CAST(CASE WHEN less > 0 THEN floor(100.0 * points / (10.0 * less + more - less)) END AS INT) AS score FROM s
UNION ALL SELECT -1 - r_regionkey, NULL, NULL, NULL FROM region"""
)
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"value": "Parameter value", "unit": "Parameter unit", "time_unit": "Time unit"}
    absent = inputs.load(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).alias("doc_id"), F.lit(0).alias("row_idx"), *[F.lit("x").alias(c) for c in names])
    baseline = inputs.from_sql(spark, sf_dir, _BASELINES, "orders").unionByName(absent).withColumnsRenamed(names)
    run = batch.batch_run("pk_individual", _answers(spark, sf_dir, "pk_individual"), ["doc_id"], baseline)
    rated = [("Time unit", False, 2.0), ("Parameter unit", False, 1.0)]
    return batch.batch_scores(baseline, run, ["doc_id"], lambda b, t: evaluate.score_tables(b, t, ["doc_id"], ["Parameter value"], rated))
