"""Batch runs: one pipeline over the documents that are asked for, then scores of its tables against baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableweave.plans.materialize import cut
from tableweave.plans.pipelines import OUTPUTS, curated


def batch_run(pipeline: str, decisions: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """A pipeline's rows for the ``wanted`` keys: a list, or the baselines themselves, whose repeats don't matter. Other
    documents' answers aren't read further; a wanted document without answers gives no rows."""
    return curated(pipeline, decisions.join(wanted.select(*keys).distinct(), keys, "left_semi"), keys)


def batch_files(pipeline: str, rows: DataFrame, pmid: str = "pmid") -> DataFrame:
    """A run's rows as ``files.write_curated`` takes them: ``pmid, pipeline, error`` before the pipeline's columns."""
    return rows.select(F.col(pmid).alias("pmid"), F.lit(pipeline).alias("pipeline"), F.lit(None).cast("string").alias("error"), *[F.col(f"`{c}`") for c in OUTPUTS[pipeline]])


def batch_scores(baseline: DataFrame, run: DataFrame, keys: list[str], score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One row for each baseline: what ``score`` (baseline, target) gives for it, nulls where the run has no table for it.

    A baseline without a target isn't given a score of 0: it is reported, not rated. Targets without a baseline are left out.
    """
    # read twice, and costly to make: written once
    target = cut(run.select(*[F.col(f"`{c}`") for c in baseline.columns]), "batch")
    told = score(baseline.join(target.select(*keys).distinct(), keys, "left_semi"), target)
    return baseline.select(*keys).distinct().join(told, keys, "left")
