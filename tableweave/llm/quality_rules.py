"""Quality rules on documents and hosts, in built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.plans.materialize import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunken failure rate is above this.
HOST_LIMIT = 0.6
HOST_MIN_PRIOR = 2.0


def bound(value: Column, body) -> Column:
    """``body(value)`` with value computed once: lambdas over arrays would else compute it anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of ``window`` words that occur at least twice, the first occurrence included.

    The windows' hashes are sorted with their places; equal neighbours are repeats. The repeated places, in order, each
    cover as many words as fit before the next one, at most ``window``.
    """

    def count(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(window)]).alias("h"), i.alias("i")),
        )
        return bound(F.sort_array(grams), covered)

    def covered(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(False),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return bound(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(words) >= window, bound(words, count)).otherwise(F.lit(0).cast("long"))


def base_metrics(text: Column) -> dict[str, Column]:
    """Whole-text measures; null text has no words, lines or symbols."""
    text = F.coalesce(text, F.lit(""))

    def lines(found: Column) -> Column:
        return (F.size(found) - F.size(F.array_distinct(found))).cast("long")

    return {
        "n_words": F.size(F.col("__words")).cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines),
        "n_repeat_words": repeat_words(F.col("__words")),
    }


def with_base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base measures and ``base_failed``; no shuffle."""
    measured = docs.withColumn("__words", words_of(F.coalesce(F.col(text_col), F.lit(""))))
    measured = measured.withColumns(base_metrics(F.col(text_col))).drop("__words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host_col: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row a host: ``host, n_docs, n_failed, rate, shrunk_rate, host_rejected``.

    The failure rates of all hosts give a beta prior by the method of moments: with mean m and variance v of the rates
    and the mean sampling variance s = mean(m(1-m)/n), the variance between hosts is max(v - s, 0) and the prior's weight
    m(1-m)/between - 1, at least ``HOST_MIN_PRIOR`` (hosts that don't differ share one rate). A host's shrunken rate is
    its posterior mean, so a host of few documents stays near the corpus. Rows without a host get no host verdict.
    """
    hosts = (
        judged.filter(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
        .withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    )
    hosts = cut(hosts, "host-rates")
    prior = hosts.agg(
        F.avg("rate").alias("m"), F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inverse"),
    ).withColumn("spread", F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inverse"), F.lit(1e-9)))
    prior = prior.withColumn("weight", F.greatest(F.lit(HOST_MIN_PRIOR), F.col("m") * (1 - F.col("m")) / F.col("spread") - 1)).select("m", "weight")
    # the prior is one row
    return (
        hosts.join(F.broadcast(prior))
        .withColumn("shrunk_rate", (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight")))
        .withColumn("host_rejected", F.col("shrunk_rate") > limit)
        .select("host", "n_docs", "n_failed", "rate", "shrunk_rate", "host_rejected")
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: the id, the base measures, ``base_failed``, the host's rate and ``kept``.

    A row is kept if it passes the base rules and its host isn't rejected. Null text has no words and fails. Extra
    columns are not read. An empty table gives an empty result.
    """
    judged = with_base_rules(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host")), "__text")
    judged = cut(judged.drop("__text"), "quality-measures")
    hosts = cut(host_verdicts(judged, "__host").select(F.col("host").alias("__host"), "shrunk_rate", "host_rejected"), "host-verdicts")
    told = judged.join(hosts, "__host", "left")
    return told.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("shrunk_rate").alias("host_failure_rate"),
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Each text is measured once."""
    own = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(text_col).alias("__text"), F.col(host_col).alias("__host"))
    judged = cut(with_base_rules(row, "__text").select("__row", "__host", "base_failed"), "quality-rows")
    hosts = cut(host_verdicts(judged, "__host").filter("host_rejected").select(F.col("host").alias("__host")), "hosts-rejected")
    return judged.filter("NOT base_failed").join(hosts, "__host", "left_anti").select("__row.*")
