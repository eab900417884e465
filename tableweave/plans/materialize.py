"""Cutting lineage with tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables that were cut lie, as long as somebody holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Lists of paths that are being recorded.
_records: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local session may do without: it gets a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own, below the shared folder, for one intermediate table."""
    path = f"{shared_dir(spark)}/tableweave/{label}-{uuid.uuid4().hex}"
    for record in _records:
        record.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    What follows starts from files that outlive any executor, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch that nothing needs any longer."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of cut tables, once all that was made of them has been written."""
    for table in tables:
        if path := _paths.pop(table, None):
            removed(table.sparkSession, [path])


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are taken meanwhile."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        _records.remove(paths)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a table that has been cut has at most ``max_rows`` rows (Parquet footers answer this)."""
    return df.count() <= max_rows


def hinted(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a cut table whose counted size allows it; otherwise leave the join to be shuffled."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def hinted_by_size(df: DataFrame, size: Column, most: int = 32_000_000) -> DataFrame:
    """As ``hinted``, by bytes: those of a row (``size``) and 64 that any row takes."""
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= most else df
