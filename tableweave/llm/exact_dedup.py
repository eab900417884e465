"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.llm.marks import marked, marks_of
from tableweave.plans.materialize import cut, hinted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 256
BROADCAST_ROWS = 100_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the built-in lower(), which is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _refined(docs: DataFrame, id_col: str, text_col: str, digest_all: bool, carried: list[Column]) -> DataFrame:
    """Rows with ``__id, __digest, __keep, __size, __copies`` (the last three null outside groups) and what is carried."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("__id"),
        text.alias("__text"),
        F.octet_length(text).alias("__n"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("__p"),
        *carried,
    )
    by_prefix = cut(keyed.groupBy("__n", "__p").agg(F.count(F.lit(1)).alias("__rows")), "dedup-prefixes")
    lengths = by_prefix.groupBy("__n").agg(F.sum("__rows").alias("__same")).filter("__same > 1").select("__n")
    survivors = by_prefix.filter("__rows > 1").join(lengths, "__n", "left_semi")
    # a bitmap tells which rows to read whole: one row too many is hashed for nothing, and its digest is nobody else's
    key = F.xxhash64("__n", "__p")
    read = marked(keyed, marks_of(survivors, key, "dedup-survivors"), key, "__open")
    whole = F.unhex(F.sha2(ascii_lower(F.col("__text")).cast("binary"), 256))
    if not digest_all:
        whole = F.when(F.col("__open"), whole)
    rest = [c for c in keyed.columns if c not in ("__id", "__text", "__n", "__p")]
    hashed = cut(read.select("__id", "__open", whole.alias("__digest"), *rest), "dedup-digests")
    groups = (
        hashed.filter("__open")
        .groupBy("__digest", "__id").agg(F.count(F.lit(1)).alias("__n"))
        .groupBy("__digest").agg(F.max(F.struct("__id", "__n")).alias("__last"), F.sum("__n").alias("__size"))
        .filter("__size > 1")
        .select("__digest", F.col("__last.__id").alias("__keep"), F.col("__last.__n").alias("__copies"), "__size")
    )
    groups = cut(groups, "dedup-groups")
    joined = hashed.filter("__open").drop("__open").join(hinted(groups, BROADCAST_ROWS), "__digest", "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name != "__digest"]
    return joined.unionByName(hashed.filter("NOT __open").select("__digest", "__id", *rest, *none))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays
    (``keep_id``). If that very row is repeated, each repeat says kept: rows that agree in id and text are one document.
    A null id never beats another id; a group of null ids keeps null and says kept.

    1. Group sizes by byte length and by a hash of the first characters come from one map-side combined count. A length
       that occurs once settles its row; a prefix that occurs once within its length settles its row.
    2. Only rows of surviving (length, prefix) groups, told by a bitmap of fixed size (``marks``), have the whole text
       hashed and grouped. ``digest_all`` also gives the others their digest (else null); it changes no decision.

    Only ids, lengths and hashes are shuffled, never texts, at any size. The join back to groups is one Spark may split when skewed.
    Other columns of ``docs`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    joined = _refined(docs, id_col, text_col, digest_all, [])
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, all their columns unchanged.

    Decisions are those of ``exact_dedup``; where the row that stays is itself repeated, one of the repeats stays. Rows
    whose text may have an equal one are the only ones to be joined, and so to be shuffled where the groups are too many to
    be broadcast.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    kept = _refined(docs, id_col, text_col, False, [row]).filter("__size IS NULL OR __id <=> __keep")
    once = kept.filter("coalesce(__copies, 1) = 1").select("__row.*")
    more = kept.filter("__copies > 1").dropDuplicates(["__digest"]).select("__row.*")
    return once.unionByName(more)
