"""Documents to packed training sequences: quality rules, exact dedup, near-dedup, personal data, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableweave.llm import exact_dedup, near_dedup, packing, pii_surrogates, quality_rules
from tableweave.llm.queries import SURROGATE_KEY, TOKENIZER, tokenizer_path
from tableweave.plans.materialize import cut, dropped, recorded, removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Metadata of a stage's first column: the scratch that the stage's result is still read from. It is written and reread with the table.
SCRATCH = "tableweave.scratch"


def stage(f: Stage) -> Stage:
    """The scratch of the stage before is given back when a stage begins, if that stage's result has been written since.

    A result carries the paths of its scratch in its schema, so that nothing is kept between stages: a table that was
    written and reread names what it no longer needs, whoever ran the stages, and however often.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        behind = list(docs.schema[0].metadata.get(SCRATCH, [])) if docs.columns else []
        if behind:
            files = docs.inputFiles()
            if files and not any(path.split("/tableweave/")[-1] in file for path in behind for file in files):
                removed(spark, behind)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        return out.withMetadata(out.columns[0], {SCRATCH: paths}) if out.columns == docs.columns else out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


@stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_personal_data(docs, SURROGATE_KEY).select(*docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(TOKENIZER), added_tokens=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]
#: Near-duplicates, surrogates and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        read, docs = docs, f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
            dropped(read)
    return docs
