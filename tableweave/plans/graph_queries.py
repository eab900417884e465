"""Queries of the step graph: each customer's orders as a source table, one recorded answer a step, and SQL for the curated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.operators import positional, reshape
from tableweave.plans import cell_queries, graph, inputs, pipelines
from tableweave.plans.catalog import query

# Source cells. Every third table has units, every fourth a second column of P values; every seventh lies on its side.
_CELLS = """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN place - 1 ELSE r END AS row_idx, CASE WHEN doc_id % 7 = 0 THEN r + 1 ELSE place END AS col_idx,
  CASE WHEN doc_id % 7 = 0 THEN 'item ' || CAST(k AS STRING) ELSE name END AS header, value, name, place, r, k FROM (
  SELECT doc_id, k, r, name, CAST(CASE name WHEN 'Item' THEN 0 WHEN 'Unit' THEN 1 WHEN 'Mean' THEN 1 + u WHEN 'Median' THEN 2 + u WHEN 'p' THEN 3 + u WHEN 'q' THEN 4 + u ELSE 4 + u + w END AS INT) AS place,
    CASE name WHEN 'Item' THEN 'item ' || CAST(k AS STRING) WHEN 'Unit' THEN 'mg' || CAST(k % 3 AS STRING) WHEN 'Mean' THEN CAST(k * 10 AS STRING) WHEN 'Median' THEN CAST(k * 10 + 1 AS STRING)
      WHEN 'p' THEN '0.0' || CAST(k % 9 AS STRING) WHEN 'q' THEN '0.1' || CAST(k % 9 AS STRING) ELSE 'n' END AS value
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS u, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS w FROM (
    SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r FROM orders)) o
  CROSS JOIN (SELECT 'Item' AS name UNION ALL SELECT 'Unit' UNION ALL SELECT 'Mean' UNION ALL SELECT 'Median' UNION ALL SELECT 'p' UNION ALL SELECT 'q' UNION ALL SELECT 'N') c
  WHERE NOT (name = 'Unit' AND u = 0) AND NOT (name = 'q' AND w = 0)) x
"""
_KEYS = ["doc_id"]


def _summary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.from_sql(spark, sf_dir, _CELLS, "orders", dealt=["o_custkey"]).filter("doc_id % 7 <> 0 OR name <> 'Item'")
    cell = F.struct("row_idx", "col_idx", "header", "value")
    # a table on its side has its column names as the first column's cells, under the first header
    side = F.struct("row_idx", F.lit(0).alias("col_idx"), F.lit("Item").alias("header"), F.col("name").alias("value"))
    return told.select("doc_id", F.inline(F.when(F.expr("doc_id % 7 = 0 AND r = 0"), F.array(side, cell)).otherwise(F.array(cell))))


def _listed(order: Column, value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def _texts(*cells: Column | str) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cells])


def _stacked(told: DataFrame, steps: dict[str, Column], subs: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """``doc_id, step, sub_id, payload``: whole tables' answers, and those of the two sub-tables."""
    rows = [F.struct(F.lit(k).alias("step"), F.lit(None).cast("int").alias("sub_id"), F.to_json(v).alias("payload")) for k, v in steps.items()]
    rows += [F.struct(F.lit(k).alias("step"), F.lit(n).alias("sub_id"), F.to_json(v).alias("payload")) for k, pair in (subs or {}).items() for n, v in enumerate(pair)]
    return told.select("doc_id", F.inline(F.array(*rows))).filter("payload IS NOT NULL")


def _summary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, doc = F.col("k"), F.col("doc_id")
    orders = inputs.from_sql(spark, sf_dir, _CELLS, "orders", dealt=["o_custkey"]).filter("name = 'Item'").select("doc_id", "k", "r")
    some = orders.filter("NOT (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND r = 0)")  # what is left once individual data are out
    text, one = k.cast("string"), doc % 3 == 1
    value = lambda n: _texts((k * 10 + n).cast("string"), ("Mean", "Median")[n], "SD", "1", "N/A", "N/A", "N/A", "0.05")
    told = some.groupBy("doc_id").agg(
        _listed(k, (k % 4).cast("int") - 1).alias("drug"), _listed(k, (k % 3).cast("int") - 1).alias("patient"), _listed(k, F.concat(F.lit("type "), text)).alias("types"),
        _listed(k, F.concat(F.lit("u "), text)).alias("units"), _listed(k, value(0)).alias("v0"), _listed(k, value(1)).alias("v1"),
        (2 * F.count_if(one | (k % 3 != 0))).cast("int").alias("clean"),
    )
    sizes = orders.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    told = sizes.join(told, "doc_id", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    has = lambda name, there: F.when(there, F.lit(name))
    headers = F.filter(F.array(F.lit("Parameter type"), has("Unit", doc % 3 == 0), F.lit("Mean"), F.lit("Median"), F.lit("p"), has("q", doc % 4 == 0), F.lit("N")), lambda c: c.isNotNull())
    kinds = {"Parameter type": "Parameter type", "Unit": "Parameter unit", "Mean": "Parameter value", "Median": "Parameter value", "p": "P value", "q": "P value", "N": "Uncategorized"}
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    shared = F.filter(headers, lambda c: ~c.isin("Mean", "Median", "p", "q"))
    times = F.transform(F.sequence(F.lit(1), F.greatest(F.col("clean") - F.when(F.col("clean") > 2, 1).otherwise(0), F.lit(1))), lambda j: _texts(F.concat(F.lit("t"), j.cast("string")), "h"))
    done = F.struct(
        ((doc % 7 != 0) & (doc % 5 < 2)).alias("processed"), F.when((doc % 5 == 0) & (F.col("n") > 1), F.sequence(F.lit(1), F.col("n") - 1)).when(doc % 5 == 0, F.array().cast("array<int>")).alias("row_list"),
        F.when(doc % 5 == 1, F.filter(F.array(F.lit("Item"), has("Unit", doc % 3 == 0), F.lit("Mean"), F.lit("Median"), F.lit("p"), has("q", doc % 4 == 0)), lambda c: c.isNotNull())).alias("col_list"),
    )
    cut_off = (doc % 5 == 1) & (doc % 7 != 0)
    present = F.when(cut_off, F.filter(headers, lambda c: c != "N")).otherwise(headers)
    split = F.array(F.concat(F.when(cut_off, F.filter(shared, lambda c: c != "N")).otherwise(shared), _texts("Mean", "p")), F.concat(F.when(cut_off, F.filter(shared, lambda c: c != "N")).otherwise(shared), _texts("Median", "q")))
    drugs = lambda names: F.array(*[_texts(f"drug {x}", "analyte", "plasma") for x in names])
    patients = lambda names: F.array(*[_texts(f"group {x}", "N/A", "adults", f"n{x}") for x in names])
    found = lambda names: F.array(*[_texts(f"group {x}", "N/A", f"n{x}") for x in names])
    steps = {
        "drug_info": F.when(doc % 2 == 0, drugs("a")).otherwise(drugs("012")), "patient_info": F.when(one, found("00")).otherwise(found("001")),
        "patient_info_refined": F.when(one, patients("0")).otherwise(patients("01")), "individual_data_del": done,
        "param_type_align": F.struct(F.when(doc % 7 != 0, "Item").alias("col_name")), "header_categorize": F.map_from_arrays(present, F.transform(present, lambda c: F.element_at(known, c))),
        "split_by_columns": split, "time_unit": F.when(doc % 2 == 0, F.array(_texts("1", "h"))).otherwise(times),
    }
    typed = F.struct(F.col("types").alias("parameter_types"), F.col("units").alias("parameter_units"))
    subs = {"drug_match": (F.col("drug"),) * 2, "patient_match": (F.col("patient"),) * 2, "param_type_unit": (typed, F.lit(None).cast("array<int>")), "param_value": (F.col("v0"), F.col("v1"))}
    return _stacked(told, steps, subs)


_ORDER = ", ".join(f'"{c}" = \'N/A\', "{c}"' for c in pipelines.IDENTITY)
_SUMMARY_SQL = f"""
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders),
b AS (SELECT doc_id, k, s, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE CAST(greatest(k % 4 - 1, 0) AS STRING) END AS d, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE k % 3 - 1 END AS p
  FROM o CROSS JOIN (SELECT unnest([0, 1]) AS s) WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND r = 0)),
t AS (SELECT doc_id, s, k, 'drug ' || d AS "Drug name", 'analyte' AS "Analyte", 'plasma' AS "Specimen", 'group ' || CAST(p AS STRING) AS "Population", 'N/A' AS "Pregnancy stage", 'adults' AS "Pediatric/Gestational age",
  'n' || CAST(p AS STRING) AS "Subject N", CASE WHEN doc_id % 3 = 0 THEN 'item ' ELSE 'type ' END || CAST(k AS STRING) AS "Parameter type",
  CASE WHEN doc_id % 3 = 0 THEN 'mg' || CAST(k % 3 AS STRING) ELSE 'u ' || CAST(k AS STRING) END AS "Parameter unit", CASE s WHEN 0 THEN 'Mean' ELSE 'Median' END AS "Parameter statistic",
  CAST(k * 10 + s AS STRING) AS "Parameter value", 'SD' AS "Variation type", '1' AS "Variation value", 'N/A' AS "Interval type", 'N/A' AS "Lower bound", 'N/A' AS "Upper bound", '0.05' AS "P value" FROM b WHERE p >= 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, s, k) - 1 AS INT) AS row_idx, count(*) OVER (PARTITION BY doc_id) AS clean FROM t)
SELECT doc_id, row_idx, {", ".join(f'"{c}"' for c in pipelines.OUTPUTS["pk_summary"][:-2])},
  CASE WHEN doc_id % 2 = 0 THEN '1' WHEN clean > 2 AND row_idx = clean - 1 AND clean > 2 THEN CASE WHEN clean = 2 THEN 't1' ELSE 'N/A' END ELSE 't' || CAST(row_idx + 1 AS STRING) END AS "Time value",
  CASE WHEN doc_id % 2 = 1 AND clean > 2 AND row_idx = clean - 1 THEN 'N/A' ELSE 'h' END AS "Time unit" FROM n
"""


@query(_SUMMARY_SQL)
def graph_pk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pk_summary(_summary_cells(spark, sf_dir), _summary_answers(spark, sf_dir), _KEYS)


# Single patients: two parameters but in every fourth table, which isn't split; every seventh lies on its side.
_PATIENTS = """
SELECT doc_id, k, r, n, name, CASE name WHEN 'Patient' THEN 0 WHEN 'Cmax' THEN 1 WHEN 'AUC' THEN 2 ELSE CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 3 END END AS place,
  CASE name WHEN 'Patient' THEN 'P' || CAST(k AS STRING) WHEN 'Cmax' THEN CAST(k AS STRING) WHEN 'AUC' THEN CAST(k * 2 AS STRING) ELSE 'x' END AS value
FROM (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS n FROM orders) o
CROSS JOIN (SELECT 'Patient' AS name UNION ALL SELECT 'Cmax' UNION ALL SELECT 'AUC' UNION ALL SELECT 'N') c WHERE NOT (name = 'AUC' AND doc_id % 4 = 0)
"""


def _individual_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    told = inputs.from_sql(spark, sf_dir, _PATIENTS, "orders", dealt=["o_custkey"])
    upright = F.struct(F.col("r").alias("row_idx"), F.col("place").alias("col_idx"), F.col("name").alias("header"), F.col("value"))
    # on its side: a row for each column but the patients', which are the headers
    side = F.struct((F.col("place") - 1).alias("row_idx"), (F.col("r") + 1).alias("col_idx"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("header"), F.col("value"))
    first = F.struct((F.col("place") - 1).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Patient").alias("header"), F.col("name").alias("value"))
    cells = F.when(F.expr("doc_id % 7 <> 0"), F.array(upright)).when(F.col("r") == 0, F.array(first, side)).otherwise(F.array(side))
    cells = told.filter("doc_id % 7 <> 0 OR place > 0").select("doc_id", F.inline(cells))
    k, doc = F.col("k"), F.col("doc_id")
    many = doc % 4 != 0
    orders = told.filter("name = 'Patient'")
    answers = orders.groupBy("doc_id").agg(
        F.max("n").alias("n"), _listed(k, F.col("r")).alias("patient"), _listed(k, _texts(F.concat(F.lit("P"), k.cast("string")), "adults", "N/A")).alias("found"),
        _listed(k, _texts(F.concat(F.lit("P"), k.cast("string")), "adults", "N/A", "N/A")).alias("refined"), _listed(k, k.cast("string")).alias("cmax"), _listed(k, (k * 2).cast("string")).alias("auc"),
        _listed(k, _texts((k % 24).cast("string"), "h")).alias("times"),
    )
    kinds = F.create_map(*[F.lit(x) for x in ("Patient", "Patient ID", "Cmax", "Parameter value", "N", "Uncategorized")])
    kinds = F.when(many, F.map_concat(kinds, F.create_map(F.lit("AUC"), F.lit("Parameter value")))).otherwise(kinds)
    steps = {
        "drug_info": F.array(_texts("drug", "analyte", "blood")), "patient_info": F.col("found"), "patient_info_refined": F.col("refined"), "summary_data_del": F.struct(F.lit(False).alias("processed")),
        "param_type_align": F.struct(F.when(doc % 7 == 0, "Patient").alias("col_name")), "header_categorize": kinds,
        "split_by_columns": F.array(_texts("Patient", "Cmax", "N"), _texts("Patient", "AUC")),
    }
    # the first answer's types are one too many, the second's patients one too few: cut, and padded with no patient
    typed = lambda name, values, more: F.struct(F.array_repeat(F.lit(name), F.col("n") + more).alias("parameter_types"), F.array_repeat(F.lit("ng"), F.col("n")).alias("parameter_units"), F.col(values).alias("parameter_values"))
    short = F.slice("patient", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))
    subs = {
        "param_type_unit": (typed("Cmax", "cmax", 1), F.when(many, typed("AUC", "auc", 0))), "drug_match": (F.array().cast("array<int>"), F.array().cast("array<int>")),
        "patient_match": (F.col("patient"), F.when(many, short)), "time_unit": (F.col("times"), F.when(many, F.array(_texts("5", "weeks")))),
    }
    return cells, _stacked(answers, steps, subs)


# One patient needs no matching. Of several, the second sub-table's last one is padded with no patient, and goes as an error.
_INDIVIDUAL_SQL = """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
b AS (SELECT *, CAST(s * n + r AS INT) AS row_idx FROM o CROSS JOIN (SELECT unnest([0, 1]) AS s) WHERE s = 0 OR doc_id % 4 <> 0)
SELECT doc_id, row_idx, 'P' || CAST(k AS STRING) AS "Patient ID", 'drug' AS "Drug name", 'analyte' AS "Analyte", 'blood' AS "Specimen", 'adults' AS "Population", 'N/A' AS "Pregnancy stage", 'N/A' AS "Pediatric/Gestational age",
  CASE s WHEN 0 THEN 'Cmax' ELSE 'AUC' END AS "Parameter type", 'ng' AS "Parameter unit", CAST(CASE s WHEN 0 THEN k ELSE k * 2 END AS STRING) AS "Parameter value",
  'N/A' AS "Time value", CASE s WHEN 0 THEN 'h' ELSE 'N/A' END AS "Time unit" FROM b WHERE s = 0 OR n = 1 OR r < n - 1
"""


@query(_INDIVIDUAL_SQL)
def graph_pk_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, answers = _individual_tables(spark, sf_dir)
    return graph.pk_individual(cells, answers, _KEYS)


def _outcome_answers(cells: DataFrame) -> DataFrame:
    kind = F.when(F.col("value").startswith("Sub "), "Subheader").when(F.col("value") == "Age", "Characteristic").otherwise("Exposure")
    heads = cells.filter("header = 'Group'").select("doc_id", "header", "value", kind.alias("kind")).distinct()
    by_header = F.create_map(*[F.lit(x) for x in ("Group", "Row headers", "Exposed", "Exposure", "Outcome", "Outcome", "P", "P value")])
    rows = heads.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "kind"))).alias("m"))
    told = _stacked(rows, {"header_categorize": by_header, "row_categorize": F.create_map(F.lit("Group"), F.col("m"))})
    # what a reader of the records would answer: each value with a unit that says which cell it was
    column_kind = F.when(F.col("header") == "Group", "Row headers").when(F.col("header") == "P", "P value").when(F.col("header") == "Exposed", "Exposure").when(F.col("header") == "Outcome", "Outcome")
    records = positional.chunked(reshape.matrix_records(cells, _KEYS, column_kind, kind), _KEYS, ["row_idx", "col_idx"], 16)
    unit = F.concat(F.lit("u"), F.col("row_idx").cast("string"), F.lit("-"), F.col("col_idx").cast("string"))
    value = _texts(F.col("value"), unit, "Mean", "SD", "N/A", "IQR", "N/A", "N/A")
    chunks = records.groupBy("doc_id", F.col("chunk").alias("sub_id")).agg(_listed(F.struct("row_idx", "col_idx"), value).alias("v"))
    return told.unionByName(chunks.select("doc_id", F.lit("param_value").alias("step"), "sub_id", F.to_json("v").alias("payload")))


@query(
    f"""WITH r AS ({cell_queries.MATRIX_RECORDS})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row_idx, col_idx) - 1 AS INT) AS row_idx, characteristic AS "Characteristic", exposure AS "Exposure", outcome AS "Outcome",
  'u' || CAST(row_idx AS STRING) || '-' || CAST(col_idx AS STRING) AS "Parameter unit", 'Mean' AS "Parameter statistic", value AS "Parameter value", 'N/A' AS "Variation type", 'N/A' AS "Variation value",
  'N/A' AS "Interval type", 'N/A' AS "Lower bound", 'N/A' AS "Upper bound", coalesce(p_value, 'N/A') AS "P value" FROM r"""
)
def graph_pe_study_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = inputs.matrix_cells(spark, sf_dir)
    return graph.pe_study_outcome(cells, _outcome_answers(cells), _KEYS)
