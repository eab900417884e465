"""Streams into the store: files that are new, and latest-wins updates, batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tableweave.operators.store import latest, new_only


def ingest_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends rows whose key the Parquet folder doesn't have. A batch that runs again finds its rows there already."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        once = rows.dropDuplicates(keys)
        (new_only(once, stored, keys) if (stored := _read(spark, path, rows)) is not None else once).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Appends each batch's latest row of each key, in a folder of the batch's own: a batch that runs again replaces it.

    ``latest`` over the folder gives the current state.
    """

    def batch(rows: DataFrame, number: int) -> None:
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(like.schema).parquet(path)


PROGRESS = "run string, name string, batch long, rows long, started timestamp, millis long"


class ProgressLog(StreamingQueryListener):
    """Counters of each batch of every stream that ends while it listens, as small files that ``progress`` reads as a table.

    A batch is a file of its own, named by run and number, so that a batch which runs again replaces its counters. Batches
    without data are reported by Spark too, and left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not p.numInputRows:
            return
        told = {"run": str(p.runId), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "started": p.timestamp, "millis": p.batchDuration}
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.runId}-{p.batchId}.json")
        out = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()

    def progress(self) -> DataFrame:
        """One row a batch: ``run, name, batch, rows, started, millis``."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], PROGRESS)
        return self.spark.read.schema(PROGRESS).json(self.path)


def totals(progress: DataFrame) -> DataFrame:
    """``name, batches, rows`` of each stream."""
    return progress.groupBy("name").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"))
