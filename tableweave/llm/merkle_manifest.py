"""A Merkle tree over a dataset's rows: leaves by partition, superblocks of levels by bucket, proofs for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.llm.ordering import indexed
from tableweave.plans.materialize import cut, hinted

FANOUT = 8
#: Levels that one bucket takes at once: 8 ** 3 = 512 nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values in their order, each ``-`` if null, else its bytes' number, ``:`` and itself."""

    def field(value: Column) -> Column:
        told = value.cast("string")
        return F.when(told.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))

    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to by its proof: each level's digest is that of its siblings with the node at its place."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def _digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def depth_of(count: int, fanout: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    depth = 0
    while count > 1:
        count, depth = -(-count // fanout), depth + 1
    return depth


def collapsed(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them; every ``fanout`` consecutive nodes become one, the last of fewer."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_digest(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return found


def siblings(found: list[list[str]], place: int, fanout: int) -> tuple[list[str], list[str]]:
    """What stands before and after the node at ``place`` in its run, and so on for the nodes above it."""
    before, after = [], []
    for level in found[:-1]:
        first = place // fanout * fanout
        before.append("".join(level[first:place]))
        after.append("".join(level[place + 1 : first + fanout]))
        place //= fanout
    return before, after


def proved(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, label: str = "merkle") -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``root`` and ``before``, ``after`` (siblings by level, from below), and the roots: ``tree, node``.

    Nodes: ``tree`` (not null), ``node`` (hex), ``__index`` (from 0 in the tree), ``__count`` (nodes of the tree) and
    columns of their own. A bucket is fanout ** levels neighbours of a tree, whatever the tree's size, so no task gets
    more than some buckets. Each bucket becomes one node; those are proved the same way, a level of buckets at a time,
    and a bucket's proof is put behind those of its nodes. The driver learns one number, the largest tree's nodes.
    """
    most = nodes.agg(F.max("__count")).head()[0] or 0
    size = fanout**levels
    if most <= 1:
        none = F.array().cast("array<string>")
        return nodes.withColumns({"root": F.col("node"), "before": none, "after": none}), nodes.select("tree", "node")
    bucketed = nodes.withColumn("__bucket", F.floor(F.col("__index") / size))

    def found_in(rows: pd.DataFrame) -> list[list[str]]:
        return collapsed(rows["node"].tolist(), min(levels, depth_of(int(rows["__count"].iloc[0]), fanout)), fanout)

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__index")
        first = rows.iloc[0]
        return pd.DataFrame({"tree": [first["tree"]], "node": found_in(rows)[-1], "__index": [first["__bucket"]], "__count": [-(-int(first["__count"]) // size)]})

    above = bucketed.select("tree", "node", "__index", "__count", "__bucket").groupBy("tree", "__bucket").applyInPandas(top, "tree string, node string, __index long, __count long")
    upper, roots = proved(cut(above, f"{label}-buckets"), fanout, levels, label)

    def joined(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__index").drop(columns="__bucket")
        found, high = found_in(rows), over.iloc[0]
        own = [siblings(found, k, fanout) for k in range(len(rows))]
        return rows.assign(root=high["root"], before=[[*x, *high["before"]] for x, _ in own], after=[[*x, *high["after"]] for _, x in own])

    over = upper.select("tree", F.col("__index").alias("__bucket"), "root", "before", "after")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", root string, before array<string>, after array<string>"
    return bucketed.groupBy("tree", "__bucket").cogroup(over.groupBy("tree", "__bucket")).applyInPandas(joined, schema), roots


def dataset_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT, levels: int = LEVELS, carried: dict[str, Column] | None = None
) -> DataFrame:
    """One row for each row of ``docs``: ``<id>, <group>, leaf, subroot, root, proof`` and what is ``carried``.

    A leaf is ``leaf_digest`` of the row's ``fields``. Leaves of a group ascend by id; while several nodes remain, every
    ``fanout`` consecutive ones become the digest of their concatenated hex texts (the last run may be shorter, and even a
    single node is digested). What remains is the group's ``subroot``; a lone leaf is its own. Subroots, in the order of
    their groups (null first, then by bytes), lead to ``root`` the same way. ``proof`` is an array of structs ``before,
    after``, the siblings by level from the leaf to the root: ``folded(leaf, proof)`` gives the root again. ``carried``
    are columns of ``docs`` to keep beside.

    Texts are read once, for the leaves; what is sorted and grouped are digests. Places come from ranges and their counts
    (``ordering.indexed``), nodes meet in buckets of fanout ** levels, so a group may hold all rows.

    A null id comes before all others; rows that share an id are ordered by their leaves, so the tree doesn't depend on
    how the rows lie. Null fields are ``-``, which no value is. Other columns aren't read. An empty table gives an empty
    result.
    """
    group = F.col(f"`{group_col}`")
    own = {"__id": F.col(f"`{id_col}`"), "__group": group, "tree": F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))}
    leaves = docs.select(
        *[c.alias(k) for k, c in own.items()], leaf_digest([F.col(f"`{c}`") for c in fields]).alias("node"), *[c.alias(k) for k, c in (carried or {}).items()],
    )
    leaves = indexed(cut(leaves, "merkle-leaves"), [F.col("__id"), F.col("node")], "tree", "merkle-ordered")
    below, subroots = proved(leaves, fanout, levels)
    # a tree's name is a node of the tree above, in which all subroots stand
    subroots = cut(subroots.select(F.col("tree").alias("name"), "node", F.lit("").alias("tree")), "merkle-subroots")
    tops, _ = proved(indexed(subroots, [F.col("name")], "tree", "merkle-groups"), fanout, levels, "merkle-top")
    tops = tops.select(F.col("name").alias("tree"), F.col("root").alias("__top"), F.col("before").alias("__before"), F.col("after").alias("__after"))
    joined = below.join(hinted(cut(tops, "merkle-tops"), 10_000), "tree")
    levels_of = F.arrays_zip(F.concat("before", "__before").alias("before"), F.concat("after", "__after").alias("after"))
    return joined.select(
        F.col("__id").alias(id_col), F.col("__group").alias(group_col), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("__top").alias("root"),
        F.transform(levels_of, lambda x: F.struct(x["before"].alias("before"), x["after"].alias("after"))).alias("proof"), *[F.col(k) for k in carried or {}],
    )
