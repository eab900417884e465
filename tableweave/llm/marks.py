"""Which of many keys are in a set, by a bitmap of fixed size: it may say yes for a key that isn't, never no for one that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.plans.materialize import cut

#: 1,024 rows of 4 KB, whatever the number of keys: 4 MB are broadcast. With very many keys all is marked.
BUCKETS, BITS = 1 << 10, 1 << 15


def _bucket(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 15), F.lit(BUCKETS))


def _bit(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS))


def marks_of(keys: DataFrame, key: Column, label: str) -> DataFrame:
    """The bitmap of the 64-bit hashes ``key`` of ``keys``: ``__bucket, __bits``."""
    each = keys.select(_bucket(key).alias("__bucket"), _bit(key).alias("__bit")).groupBy("__bucket")
    return cut(each.agg(F.bitmap_construct_agg("__bit").alias("__bits")), label)


def marked(df: DataFrame, marks: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether the bitmap has the row's key. Narrow."""
    found = df.withColumn("__bucket", _bucket(key)).join(F.broadcast(marks), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(_bit(key) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (_bit(key) % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")
