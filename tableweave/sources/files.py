"""Readers and writers of files: manifests, CSV tables, benchmark folders, curated tables by pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.operators.store import latest


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; all cells are texts, without byte-order marks, in headers too."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    tidy = df.select(*[F.translate(F.col(f"`{c}`"), "﻿", "").alias(c.replace("﻿", "")) for c in df.columns])
    return tidy


def captions(spark: SparkSession, path: str) -> DataFrame:
    """``caption, footnote`` of JSON files, one object each; fields that are missing are null."""
    return spark.read.schema("caption string, footnote string").option("multiLine", True).json(path)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html`` of HTML files, each as a whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def manifest(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """``pmid, html_path`` of a manifest CSV: blank rows and a header line are skipped, relative paths resolved."""
    rows = spark.read.schema("pmid string, html_path string").csv(path)
    rows = rows.select(F.trim("pmid").alias("pmid"), F.trim("html_path").alias("html_path"))
    rows = rows.filter((F.coalesce("pmid", F.lit("")) != "") & ~F.lower("pmid").isin("pmid", "pmcid"))
    absolute = F.col("html_path").rlike(r"^(/|[a-z][a-z0-9+.-]*:)")
    return rows.withColumn("html_path", F.when(absolute, F.col("html_path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "html_path")) if base else F.col("html_path"))


def pmid_list(spark: SparkSession, text: str) -> DataFrame:
    """``pmid`` of a comma-separated list."""
    one = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("pmid"))
    return one.select(F.trim("pmid").alias("pmid")).filter("pmid <> ''")


def first_column_list(rows: DataFrame, order: str, column: str) -> DataFrame:
    """The values of a column up to the first empty one, in the given order."""
    empty = rows.filter(F.coalesce(F.trim(column), F.lit("")) == "").agg(F.min(order).alias("__stop"))
    # one row
    return rows.join(F.broadcast(empty)).filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, file, html``: the newest HTML file in each pmid's folder below ``path``."""
    files = spark.read.text(f"{path}/*/*.html", wholetext=True).withColumn("file", F.input_file_name())
    named = files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("pmid"), "file", F.col("value").alias("html"))
    return latest(named, ["pmid"], ["file"])


def benchmark_files(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    """``file, pmid, model`` of ``{pmid}_{model}[_suffix].csv`` below ``path``; unknown models are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    name = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    named = files.select("file", F.regexp_extract(name, r"^([0-9]+)_", 1).alias("pmid"), F.regexp_extract(name, r"^[0-9]+_([A-Za-z0-9.-]+)", 1).alias("model"))
    return named.filter((F.col("pmid") != "") & F.col("model").isin(*models))


def benchmark_kind(path: Column) -> Column:
    """``pk-summary``, ``pk-individual`` or ``pe`` by the folders of a path, null for others."""
    kind = F.regexp_extract(path, r"/(pk-summary|pk-individual|pe)/", 1)
    return F.when(kind != "", kind)


def result_folder(target: str, baseline: str) -> str:
    return f"{target}-{baseline}".replace("/", "_")


def write_curated(tables: DataFrame, path: str, error: str = "error") -> None:
    """Curated rows as CSV by pmid and pipeline, and errors beside them; rows without a table aren't written."""
    tables.filter(F.col(error).isNull()).drop(error).write.mode("append").partitionBy("pmid", "pipeline").option("header", True).csv(f"{path}/tables")
    tables.filter(F.col(error).isNotNull()).select("pmid", "pipeline", error).write.mode("append").json(f"{path}/errors")


def append_scores(scores: DataFrame, path: str) -> None:
    """Appends ``model, pmid, score`` to a log."""
    scores.select("model", "pmid", F.col("score").cast("string")).write.mode("append").option("sep", ",").csv(path)


def rewritten_copy(spark: SparkSession, source: str, target: str, transform) -> None:
    """A normalised copy of a CSV table at another place; the original stays as it is."""
    read_csv(spark, source).transform(transform).write.mode("overwrite").option("header", True).csv(target)


def write_markdown_as_csv(tables: DataFrame, path: str, key: str, markdown: str = "markdown") -> None:
    """Markdown tables (``key, markdown``) as CSV texts with their header lines, a folder ``key=...`` each, lines in order."""
    from tableweave.operators import cells, codecs

    rows = cells.to_rows(codecs.from_markdown(tables.select(key, F.col(markdown).alias("markdown")), [key]), [key])
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda c: F.array_join(F.transform(c, quoted), ",")
    lines = rows.select(key, (F.col("row_idx") + 1).alias("n"), line(F.col("cells")).alias("value"))
    heads = rows.groupBy(key).agg(F.min_by("headers", "row_idx").alias("h")).select(key, F.lit(0).alias("n"), line(F.col("h")).alias("value"))
    both = heads.unionByName(lines).repartition(key).sortWithinPartitions(key, "n")
    both.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)
