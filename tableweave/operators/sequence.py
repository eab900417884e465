"""Rows in their order within a table: what stands before one, what is carried on, what is joined up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_previous(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The value of ``column`` in the row before; null in the first."""
    return df.withColumn(name, F.lag(F.col(f"`{column}`")).over(W.partitionBy(*keys).orderBy(*order)))


def adjacent_distinct(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Without rows that are equal in ``columns`` to the row before; the first of a run stays, and a null equals a null."""
    value = F.struct(*[F.col(f"`{c}`") for c in columns])
    told = df.withColumn("__now", value)
    told = with_previous(told.withColumn("__first", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1), keys, order, "__now", "__before")
    return told.filter(F.col("__first") | ~F.col("__now").eqNullSafe(F.col("__before"))).drop("__now", "__first", "__before")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the nearest row, from this one upwards, where it isn't null."""
    up = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(up))


def joined(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, joint: str = ", ", distinct: bool = False) -> DataFrame:
    """``keys, name``: a table's texts in order as one; if ``distinct``, each only where it comes first. Nulls are left out."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(f"`{column}`").alias("__text"))))
    texts = F.filter(F.transform(packed, lambda x: x["__text"]), lambda t: t.isNotNull())
    return df.groupBy(*keys).agg((F.array_distinct(texts) if distinct else texts).alias("__texts")).select(*keys, F.array_join("__texts", joint).alias(name))
