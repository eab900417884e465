"""Queries of the scoring operators and of the pipelines' assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.operators import evaluate, positional
from tableweave.plans import inputs, pipelines
from tableweave.plans.catalog import query

# A table of orders for each customer, and a copy with changed priorities and prices and without its last row now and then.
_TARGET = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, CAST(o_orderkey AS STRING) AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'zzz' ELSE o_orderpriority END AS priority, CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS STRING) AS price
FROM orders
"""
_BASELINE = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, CAST(o_orderkey AS STRING) AS name,
  o_orderpriority AS priority, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS price
FROM orders
"""
_RATED = [("priority", False, 2.0), ("price", True, 1.0)]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    baseline = inputs.from_sql(spark, sf_dir, _BASELINE, "orders")
    target = inputs.from_sql(spark, sf_dir, _TARGET, "orders").filter("row_idx > 0 OR doc_id % 2 = 0")
    return baseline, target


_PAIRED = f"""WITH b AS ({_BASELINE}), t AS (SELECT * FROM ({_TARGET}) WHERE row_idx > 0 OR doc_id % 2 = 0),
j AS (SELECT b.doc_id AS bd, t.doc_id AS td, coalesce(b.doc_id, t.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL AND t.doc_id IS NOT NULL AND b.priority = t.priority THEN 1 ELSE 0 END AS te,
  CASE WHEN b.doc_id IS NOT NULL AND t.doc_id IS NOT NULL AND b.price = t.price THEN 1 ELSE 0 END AS ne FROM b FULL JOIN t ON b.doc_id = t.doc_id AND b.row_idx = t.row_idx),
g AS (SELECT doc_id, count(bd) AS nb, count(td) AS nt, sum(te) AS text_equal, sum(ne) AS number_equal, sum(CAST(floor(10.0 * (2 * te + ne) / 3.0) AS BIGINT)) AS s FROM j GROUP BY doc_id)
SELECT doc_id, least(nb, nt) AS less_rows, greatest(nb, nt) AS more_rows, text_equal, number_equal, CAST(floor(100.0 * s / (10.0 * least(nb, nt) + greatest(nb, nt) - least(nb, nt))) AS INT) AS score FROM g WHERE nb > 0 AND nt > 0"""


@query(_PAIRED)
def positional_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_by_position(*_tables(spark, sf_dir), ["doc_id"], _RATED)


# Names are unique in a table, so the one anchor finds the row of the same name, and narrowing has nothing left to do.
@query(
    f"""WITH b AS ({_BASELINE}), t AS (SELECT * FROM ({_TARGET}) WHERE row_idx > 0 OR doc_id % 2 = 0),
n AS (SELECT doc_id, nb, coalesce(nt, 0) AS nt FROM (SELECT doc_id, count(*) AS nb FROM b GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nt FROM t GROUP BY doc_id) USING (doc_id)),
g AS (SELECT b.doc_id, sum(CAST(floor(10.0 * (CASE WHEN b.priority = t.priority THEN 2 ELSE 0 END + CASE WHEN b.price = t.price THEN 1 ELSE 0 END) / 3.0) AS BIGINT)) AS s FROM b JOIN t ON b.doc_id = t.doc_id AND b.name = t.name GROUP BY b.doc_id)
SELECT n.doc_id, CAST(least(nb, nt) AS INT) AS less_rows, CAST(greatest(nb, nt) AS INT) AS more_rows, CAST(floor(100.0 * coalesce(s, 0) / (10.0 * least(nb, nt) + greatest(nb, nt) - least(nb, nt))) AS INT) AS score FROM n LEFT JOIN g ON n.doc_id = g.doc_id"""
)
def anchored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_tables(*_tables(spark, sf_dir), ["doc_id"], ["name"], _RATED)


# Two anchors: the first one's values occur several times in a table or not at all in the other one, which starts again from
# all rows. The answer is the first of the last anchor's matches, in row order; tables without target rows score 0.
_ANCHORED = """SELECT doc_id, row_idx, CASE WHEN row_idx % 4 = 3 THEN '{only}' WHEN row_idx % 2 = 0 THEN 'alpha' ELSE 'beta' END AS first, priority, price FROM ({table})"""


@query(
    f"""WITH b AS ({_ANCHORED.format(only='left', table=_BASELINE)}), t AS ({_ANCHORED.format(only='right', table=_TARGET)} WHERE row_idx > 0 OR doc_id % 2 = 0),
z AS (SELECT doc_id, nb, coalesce(nt, 0) AS nt FROM (SELECT doc_id, count(*) AS nb FROM b GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nt FROM t GROUP BY doc_id) USING (doc_id)),
small AS (SELECT b.* FROM b JOIN z USING (doc_id) WHERE nb <= nt UNION ALL SELECT t.* FROM t JOIN z USING (doc_id) WHERE nb > nt),
large AS (SELECT t.* FROM t JOIN z USING (doc_id) WHERE nb <= nt UNION ALL SELECT b.* FROM b JOIN z USING (doc_id) WHERE nb > nt),
f AS (SELECT s.doc_id, s.row_idx, count(l.row_idx) AS hits, min(l.row_idx) AS one FROM small s LEFT JOIN large l ON s.doc_id = l.doc_id AND s.first = l.first GROUP BY ALL),
g AS (SELECT s.doc_id, s.row_idx, min(l.row_idx) AS mate FROM small s JOIN f USING (doc_id, row_idx) LEFT JOIN large l ON s.doc_id = l.doc_id AND s.priority = l.priority AND (hits = 0 OR s.first = l.first) GROUP BY ALL),
m AS (SELECT doc_id, row_idx, CASE WHEN hits = 1 THEN one ELSE mate END AS mate FROM f JOIN g USING (doc_id, row_idx)),
p AS (SELECT m.doc_id, sum(CASE WHEN s.priority = l.priority THEN 10.0 ELSE 0 END) AS te, sum(CASE WHEN s.price = l.price THEN 10.0 ELSE 0 END) AS ne
  FROM m JOIN small s USING (doc_id, row_idx) JOIN large l ON l.doc_id = m.doc_id AND l.row_idx = m.mate GROUP BY m.doc_id)
SELECT doc_id, CAST(least(nb, nt) AS INT) AS less_rows, CAST(greatest(nb, nt) AS INT) AS more_rows, CAST(floor(100.0 * coalesce(te, 0) / (10.0 * least(nb, nt) + greatest(nb, nt) - least(nb, nt))) AS INT) AS text_score,
  CAST(floor(100.0 * coalesce(ne, 0) / (10.0 * least(nb, nt) + greatest(nb, nt) - least(nb, nt))) AS INT) AS number_score FROM z LEFT JOIN p USING (doc_id)"""
)
def separate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df, only: df.select("doc_id", "row_idx", F.when(F.col("row_idx") % 4 == 3, only).when(F.col("row_idx") % 2 == 0, "alpha").otherwise("beta").alias("first"), "priority", "price")
    baseline, target = _tables(spark, sf_dir)
    return evaluate.score_tables_separately(named(baseline, "left"), named(target, "right"), ["doc_id"], ["first", "priority"], _RATED)


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def unmatched_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = inputs.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return evaluate.unmatched_targets(targets, inputs.load(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id")), ["doc_id"])


@query("SELECT replace(replace(trim(s_name), '·', '.'), '•', '.') AS \"Drug name\", CAST(s_suppkey AS STRING) AS \"Subject N\", CAST(NULL AS STRING) AS \"P value\" FROM supplier")
def harmonized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" Subjects n"), F.concat(F.lit(" "), "s_name").alias("drug NAME "), F.lit("x").alias("other"))
    return evaluate.harmonized(raw, ["Drug name", "Subject N", "P value"], {"Subjects N": "Subject N"})


_SUMMARY = pipelines.OUTPUTS["pk_drug_summary"]


@query(
    """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, 'drug ' || CAST(o_orderkey % 5 AS STRING) AS "Drug/Metabolite name", CAST(o_orderkey % 50 AS STRING) AS "Dose amount",
  'mg' AS "Dose unit", 'N/A' AS "Dose frequency", 'N/A' AS "Dose schedule", 'N/A' AS "Dose route", c_mktsegment AS "Population", 'N/A' AS "Pregnancy stage", 'N/A' AS "Pediatric/Gestational age", 'N/A' AS "Subject N", 'N/A' AS "Note"
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def assembled_drug_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    doses = positional.numbered(orders, ["doc_id"], ["o_orderkey"]).select(
        "doc_id", "row_idx", F.concat(F.lit("drug "), (F.col("o_orderkey") % 5).cast("string")).alias("Drug/Metabolite name"), (F.col("o_orderkey") % 50).cast("string").alias("Dose amount"), F.lit("mg").alias("Dose unit")
    )
    who = inputs.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("Population"))
    patients = positional.replicated(doses.select("doc_id", "row_idx"), who, ["doc_id"])
    return pipelines.assemble("pk_drug_summary", [doses, patients], ["doc_id"])


# Names in letters of one length, so that none abbreviates another; each stands for a vector. The target's names are others.
_LETTERS = "translate(lpad(CAST({x} AS STRING), 4, '0'), '0123456789', 'abcdefghij')"
_NAMED = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, CAST(o_orderkey AS STRING) AS value, {name} AS name FROM orders
"""


@query(
    f"""WITH n AS (SELECT o_custkey AS doc_id, o_orderkey % 500 AS a, (o_orderkey * 7 + o_custkey % 2) % 500 AS b FROM orders),
s AS (SELECT doc_id, CASE WHEN a = b OR list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.42 THEN 10 ELSE 0 END AS points FROM n
  LEFT JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b)
SELECT doc_id, CAST(count(*) AS INT) AS less_rows, CAST(count(*) AS INT) AS more_rows, CAST(floor(100.0 * sum(points) / (10.0 * count(*))) AS INT) AS score FROM s GROUP BY doc_id"""
)
def embedded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda x: inputs.from_sql(spark, sf_dir, _NAMED.format(name=_LETTERS.format(x=x)), "orders", dealt=["o_custkey"])
    baseline, target = made("o_orderkey % 500"), made("(o_orderkey * 7 + o_custkey % 2) % 500")
    vectors = inputs.load(spark, sf_dir, "embeddings").select(F.expr(_LETTERS.format(x="vec_id")).alias("text"), F.col("embedding").cast("array<double>").alias("vector"))
    return evaluate.score_tables_by_vectors(baseline, target, ["doc_id"], ["value"], [("name", False, 1.0)], vectors)
