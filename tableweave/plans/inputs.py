"""Text tables made of the driver's tables, in SQL that Spark and the oracle both read: inputs of queries, not operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.operators.cells import numbered_in_blocks

#: Order keys that are numbered together: 2 to this power.
ORDER_BITS = 20

# One table of parameter rows for each order, with missing values, errors, ranges and repeats by the keys' remainders.
ASSEMBLED = """
SELECT l_orderkey AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS row_idx,
  'drug ' || CAST(l_partkey % 2 AS STRING) AS drug_name,
  CASE WHEN l_suppkey % 5 = 0 THEN 'N/A' ELSE CAST(l_suppkey % 4 AS STRING) END AS subject_n,
  CASE WHEN l_partkey % 97 = 0 THEN 'ERROR' WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 5 = 0 THEN 'unknown' ELSE 'AUC' END AS parameter_type,
  CASE WHEN l_partkey % 6 = 0 THEN 'N/A' WHEN l_partkey % 6 = 1 THEN '2.5' WHEN l_partkey % 6 = 2 THEN '2.5-7.5' ELSE CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING) END AS main_value,
  CASE WHEN l_partkey % 6 < 2 THEN 'N/A' WHEN l_suppkey % 3 = 0 THEN 'Median' ELSE 'Mean' END AS statistics_type,
  CASE WHEN l_linenumber % 2 = 0 THEN 'S.D.' ELSE 'n/a' END AS variation_type,
  CASE WHEN l_suppkey % 2 = 0 THEN 'N/A' ELSE CAST(l_suppkey % 9 AS STRING) END AS variation_value,
  CASE WHEN l_suppkey % 4 = 0 THEN '95% CI' WHEN l_suppkey % 4 = 1 THEN 'N/A' ELSE 'IQR' END AS interval_type,
  CASE WHEN l_suppkey % 4 = 0 THEN '2.5' WHEN l_suppkey % 4 = 1 THEN 'N/A' WHEN l_suppkey % 4 = 2 THEN '1.5 - 8.5' ELSE '' END AS lower_bound,
  CASE WHEN l_suppkey % 4 = 0 THEN '7.5' ELSE 'N/A' END AS upper_bound
FROM lineitem
"""
ASSEMBLED_COLUMNS = ["drug_name", "subject_n", "parameter_type", "main_value", "statistics_type", "variation_type", "variation_value", "interval_type", "lower_bound", "upper_bound"]

# Single patients' values with times, one table for each customer.
INDIVIDUAL = """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' ELSE 'P' || CAST(o_orderkey % 3 AS STRING) END AS patient_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Cmax' WHEN o_orderkey % 5 = 1 THEN ' ' ELSE 'Concentration' END AS parameter_type,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN 'Tmax' ELSE CAST(o_custkey % 50 AS STRING) END AS parameter_value,
  'ng/ml' AS parameter_unit,
  CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 24 AS STRING) END AS time_value,
  CASE WHEN o_orderkey % 6 = 0 THEN 'weeks' WHEN o_orderkey % 6 = 1 THEN 'N/A' ELSE 'h' END AS time_unit
FROM orders
"""
INDIVIDUAL_COLUMNS = ["patient_id", "parameter_type", "parameter_value", "parameter_unit", "time_value", "time_unit"]

# Small tables of orders by customer, a third of all orders in one table; and what the customers are called.
NATION = """(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS n_regionkey, o_orderkey AS n_nationkey,
  CASE WHEN o_orderkey % 2 = 0 THEN 'even ' ELSE 'odd ' END || CAST(o_orderkey AS STRING) AS n_name FROM orders)"""
REGION = "(SELECT c_custkey AS r_regionkey, c_name AS r_name FROM customer)"
_NUMBERED = f"(SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS r FROM {NATION} t)"
# The tables' cells: three columns, one without a header, one repeated header.
NATION_CELLS = f"""
SELECT n_regionkey AS doc_id, r - 1 AS row_idx, c AS col_idx,
  CASE c WHEN 0 THEN 'name' WHEN 1 THEN '' WHEN 2 THEN 'key' WHEN 3 THEN 'key' ELSE '' END AS header,
  CASE c WHEN 0 THEN n_name WHEN 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'k' || CAST(n_nationkey AS STRING) END
    WHEN 2 THEN CAST(n_nationkey AS STRING) WHEN 3 THEN CAST(n_regionkey AS STRING) ELSE ' ' END AS value
FROM {_NUMBERED} n
CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k
"""

# A table for each customer with row headers, a subheader now and then, values and P values.
MATRIX_CELLS = """
SELECT o_custkey AS doc_id, r AS row_idx, c AS col_idx,
  CASE c WHEN 0 THEN 'Group' WHEN 1 THEN 'Exposed' WHEN 2 THEN 'Outcome' WHEN 3 THEN 'P' ELSE 'Other' END AS header,
  CASE c WHEN 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Sub ' || o_orderstatus WHEN o_orderkey % 4 = 1 THEN 'Age' ELSE 'Dose' END
    WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE CAST(o_orderkey % 100 AS STRING) END
    WHEN 2 THEN CAST(o_orderkey % 7 AS STRING) WHEN 3 THEN '0.0' || CAST(o_orderkey % 9 AS STRING) ELSE 'x1' END AS value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r FROM orders) o
CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows over several tasks a core, however few files or row groups hold them: a small file can be a lot of work.

    The number is given, so that the tasks aren't put together again by their bytes, which say little about work to come. It
    isn't that of other shuffles: where rows are dealt out alike already, Spark would leave this one out and keep that one.
    """
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)
    return df.repartition(n, *by)


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str, dealt: list[str] | None = None) -> DataFrame:
    """SQL over the named tables, without registering names that other sessions' queries could meet. With ``dealt`` the
    tables' rows are dealt out by these columns before they are made larger."""
    frames = {t: load(spark, sf_dir, t) for t in tables}
    if dealt:
        frames = {t: dealt_out(df, dealt) for t, df in frames.items()}
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t})", f"FROM {{{t}}})")
    return spark.sql(sql, **frames)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ASSEMBLED, "lineitem")


def individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, INDIVIDUAL, "orders")


def over_orders(sql: str) -> str:
    """SQL over ``nation`` and ``region`` as SQL over the tables that stand for them."""
    own = {"nation": NATION, "region": REGION}
    return re.sub(r"(FROM|JOIN) (nation|region)\b( n\b)?", lambda m: f"{m[1]} {own[m[2]]} {'n' if m[3] else m[2]}", sql)


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, f"SELECT * FROM {NATION}", "orders")


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, f"SELECT * FROM {REGION}", "customer")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows are numbered in blocks, as one of the tables has a third of all orders
    numbered = numbered_in_blocks(nation(spark, sf_dir), ["n_regionkey"], "n_nationkey", "r0", ORDER_BITS).withColumn("r", F.col("r0") + 1)
    return spark.sql(NATION_CELLS.replace(_NUMBERED, "{numbered}"), numbered=numbered)


def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, MATRIX_CELLS, "orders")
