"""A store of curated tables: an append-only log of which the latest row of a key counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CURATION = "pmid string, curation_type string, source_tables string, logs string, md_table string, token_usage string, modified_time timestamp, deleted boolean"
KEYS = ["pmid", "curation_type"]


def latest(log: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key, all columns, by a map-side combined maximum; orders other than descending ones by a window.

    Keys come from the grouping itself, so that a filter on them is applied before it, down to the files.
    """
    if all(isinstance(c, str) for c in order):
        rest = [c for c in log.columns if c not in keys]
        best = log.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__last"))
        return best.select(*[F.col(f"__last.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in log.columns])
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order])
    return log.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest_values(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last values of each key by a map-side combined maximum, for few narrow columns and hot keys."""
    best = log.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in (order, *values)])


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored yet."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def ingest_report(incoming: DataFrame, stored: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """``status, n``: how many incoming rows are inserted, skipped as known, or failed."""
    known = stored.select(*keys).distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("__known"), "skipped").when(failed, "failed").otherwise("inserted")
    return incoming.join(known, keys, "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


class CurationStore:
    """Curation records in a Parquet folder; every change appends rows, so writers don't rewrite what others read.

    The log is partitioned by curation type, so lookups of one type read that partition alone. ``compact`` writes a base of
    the latest rows beside the log (in ``_base``, which readers of the folder don't see): partitioned by type, sorted by
    pmid, with a list of the log's files that it covers, written last. Reads take the newest whole base and the log's files
    that aren't covered by it: whoever began with an older base still finds all it needs, until ``vacuum``. Deletions stay
    in a base as such, so a late change of an earlier time doesn't bring a record back.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        p, fs = self._hadoop(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _files(self) -> list[str]:
        """The log's data files, as paths below the folder."""
        kinds = [x for x in self._children(self.path) if x.startswith("curation_type=")]
        return [f"{k}/{x}" for k in kinds for x in self._children(f"{self.path}/{k}") if not x.startswith(("_", "."))]

    def _bases(self) -> list[str]:
        """Whole bases, the newest last."""
        names = [x for x in self._children(f"{self.path}/_base") if "_covered" in self._children(f"{self.path}/_base/{x}")]
        return [f"{self.path}/_base/{x}" for x in names]

    def _covered(self, base: str) -> set[str]:
        return {r.value for r in self.spark.read.text(f"{base}/_covered/list").collect()}

    def log(self) -> DataFrame:
        """Everything that counts: the newest base, and what was appended since."""
        base = self._bases()[-1:]
        seen = self._covered(base[0]) if base else set()
        since = [f"{self.path}/{x}" for x in self._files() if x not in seen]
        parts = [self.spark.read.schema(CURATION).parquet(x) for x in base]
        parts += [self.spark.read.schema(CURATION).option("basePath", self.path).parquet(*since)] if since else []
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], CURATION)

    def compact(self, files: int = 1) -> str:
        """A new base of the latest rows, in ``files`` files a type by ranges of pmid; returns its folder."""
        covered = self._files()
        state = latest(self.log(), KEYS, ["modified_time"])
        number = int(self._bases()[-1].rsplit("/", 1)[1].split("-")[0]) + 1 if self._bases() else 0
        base = f"{self.path}/_base/{number:08d}-{uuid.uuid4().hex}"
        by = F.pmod(F.xxhash64("curation_type"), F.lit(1 << 20))
        state.repartitionByRange(max(1, files) * 8, by, "curation_type", "pmid").sortWithinPartitions("curation_type", "pmid").write.partitionBy("curation_type").parquet(base)
        # the list comes last: without it nobody takes the base for whole
        self.spark.createDataFrame([(x,) for x in covered], "value string").coalesce(1).write.text(f"{base}/_covered/list")
        return base

    def vacuum(self) -> None:
        """Deletes the log's files that the newest base covers, and older bases: to be called when no reader is at work."""
        bases = self._bases()
        gone = [f"{self.path}/{x}" for x in self._covered(bases[-1])] + bases[:-1] if bases else []
        for path in gone:
            p, fs = self._hadoop(path)
            fs.delete(p, True)

    def _append(self, rows: DataFrame) -> None:
        fields = [f.strip().split() for f in CURATION.split(",")]
        have = {c: F.col(c) for c in rows.columns} | ({} if "modified_time" in rows.columns else {"modified_time": F.current_timestamp()})
        rows.select(*[have.get(n, F.lit(False) if n == "deleted" else F.lit(None)).cast(t).alias(n) for n, t in fields]).write.mode("append").partitionBy("curation_type").parquet(self.path)

    def current(self) -> DataFrame:
        return latest(self.log(), KEYS, ["modified_time"]).filter("NOT coalesce(deleted, false)").drop("deleted")

    def upsert(self, rows: DataFrame) -> None:
        """Inserts records or replaces those of the same key."""
        self._append(rows)

    def update(self, rows: DataFrame) -> bool:
        """Replaces records that exist; false, and nothing changed, if none of them does."""
        known = rows.join(self.current().select(*KEYS), KEYS, "left_semi")
        if known.isEmpty():
            return False
        self._append(known)
        return True

    def delete(self, keys: DataFrame) -> bool:
        known = keys.select(*KEYS).join(self.current().select(*KEYS), KEYS, "left_semi")
        if known.isEmpty():
            return False
        self._append(known.withColumn("deleted", F.lit(True)))
        return True

    def get(self, pmid: str, curation_type: str) -> DataFrame:
        return self.current().filter((F.col("pmid") == pmid) & (F.col("curation_type") == curation_type))

    def by_pmid(self, pmid: str) -> DataFrame:
        return self.current().filter(F.col("pmid") == pmid).orderBy(F.desc("modified_time"))

    def by_type(self, curation_type: str) -> DataFrame:
        return self.current().filter(F.col("curation_type") == curation_type).orderBy(F.desc("modified_time"))

    def all(self) -> DataFrame:
        return self.current().orderBy(F.desc("modified_time"))

    def count(self) -> int:
        return self.current().count()


def total_usage(usage: DataFrame, by: list[str], column: str = "token_usage") -> DataFrame:
    """Summed ``total, prompt, completion`` counts of a struct column."""
    return usage.groupBy(*by).agg(*[F.sum(F.col(column)[k]).alias(k) for k in ("total", "prompt", "completion")])
