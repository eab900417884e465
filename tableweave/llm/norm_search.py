"""Exact search for the largest inner products: buckets of vectors of similar length, pruned by what each could reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableweave.llm.ordering import indexed
from tableweave.plans.materialize import cut

SCALE = 1024
#: Components of one bucket, so that a bucket's size doesn't depend on the vectors' dimension.
BUCKET_COMPONENTS = 1 << 17
QUERIES_A_BLOCK = 1024
#: A cell of the search holds at most so many buckets, and so many query blocks.
CELL_BUCKETS, CELL_BLOCKS = 32, 4
#: From this local cosine threshold on, a query prunes a bucket by coordinates, below it by length.
COORDINATES_FROM = 0.9
FOCUS = 6
#: Relative room for rounding in whatever prunes.
ROOM = 1e-9
LEAST = np.iinfo(np.int64).min
BLOCK = "place long, kind string, width int, ids binary, rows binary, norms binary"


def packed(rows: pd.DataFrame, scale: float, width: int, id_col: str) -> pd.DataFrame:
    """One row with a block's ids, scaled vectors in the smallest type that holds them, and their lengths, longest first."""
    found = np.zeros((len(rows), width))
    for k, x in enumerate(rows["embedding"]):
        found[k, : len(x)] = np.floor(np.asarray(x, dtype=np.float64) * scale)
    top = np.abs(found).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    norms = np.sqrt((found * found).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    found, norms, rows = found[order], norms[order], rows.iloc[order]
    return pd.DataFrame({"place": rows["block"].iloc[:1], "kind": kind, "width": width, "ids": rows[id_col].to_numpy().astype("<i8").tobytes(), "rows": found.astype(kind).tobytes(), "norms": norms.astype("<f8").tobytes()})


class Block:
    """Vectors of a block; for a bucket also its coordinates in their order, made when they are first asked for."""

    def __init__(self, ids: bytes, rows: bytes, norms: bytes, kind: str, width: int) -> None:
        self.ids, self.norms = np.frombuffer(ids, "<i8"), np.frombuffer(norms, "<f8")
        self.rows = np.frombuffer(rows, kind).reshape(-1, width).astype(np.float64)
        self._sorted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def by_coordinate(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors; for each coordinate the rows in its order, and the coordinate's values in that order."""
        if self._sorted is None:
            unit = self.rows / np.where(self.norms > 0, self.norms, 1)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._sorted = unit, order, np.take_along_axis(unit, order, axis=0)
        return self._sorted


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of integer vectors as longs: exact in doubles below 2**53, else by Python's integers, cut off at 64 bits."""
    if bound < 2**53:
        return (q @ p.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in p], dtype=object).reshape(p.shape).T
    return np.clip(whole, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def in_focus(bucket: Block, unit: np.ndarray, threshold: float, focus: int) -> np.ndarray:
    """Rows of a bucket whose cosine with ``unit`` may be ``threshold`` or more, by the coordinates where it is largest.

    A vector within the angle w of the query has each coordinate's angle within w of the query's. The coordinate with
    the fewest rows in its range gives the candidates, the others thin them out.
    """
    _, order, values = bucket.by_coordinate()
    axes = np.argsort(-np.abs(unit), kind="stable")[:focus]
    near, w = np.arccos(np.clip(unit[axes], -1, 1)), np.arccos(min(1.0, threshold))
    low, high = np.cos(np.minimum(np.pi, near + w)) - ROOM, np.cos(np.maximum(0, near - w)) + ROOM
    ends = [(np.searchsorted(values[:, f], a), np.searchsorted(values[:, f], b, side="right")) for f, a, b in zip(axes, low, high, strict=True)]
    best = int(np.argmin([b - a for a, b in ends]))
    rows = order[ends[best][0] : ends[best][1], axes[best]]
    there = bucket.by_coordinate()[0][np.ix_(rows, axes)]
    return rows[((there >= low) & (there <= high)).all(axis=1)]


class Found:
    """The best so far of each query of a block: (score, id), and the score that others must reach."""

    def __init__(self, queries: Block, reach: np.ndarray, k: int) -> None:
        self.queries, self.k, self.reach = queries, k, reach.copy()
        self.rows = (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(query):
            return
        q, s, v = (np.concatenate(x) for x in zip(self.rows, (query, score, vec), strict=True))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, q)
        stay = np.arange(len(q)) - first < self.k
        self.rows = q[stay], s[stay], v[stay]
        full = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.reach[q[full]] = np.maximum(self.reach[q[full]], s[full])

    def open_to(self, length: float) -> np.ndarray:
        """Which queries may still gain from vectors of at most this length."""
        return (self.reach <= 0) | (self.queries.norms * length * (1 + ROOM) >= self.reach)

    def search(self, bucket: Block) -> None:
        """Looks through one bucket."""
        own, top = self.queries, bucket.norms.max(initial=0)
        live = self.open_to(top)
        if not live.any():
            return
        most = own.norms * top * (1 + ROOM)
        bound = float(most.max())
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where((self.reach > 0) & (most > 0), self.reach / most, 0.0)
        by_coordinate = live & (local >= COORDINATES_FROM) & (bound < 2**53)
        hits = []
        for i in np.flatnonzero(by_coordinate):
            rows = in_focus(bucket, own.rows[i] / own.norms[i], local[i] * (1 - ROOM), FOCUS)
            rows = rows[bucket.ids[rows] != own.ids[i]]
            score = products(own.rows[i : i + 1], bucket.rows[rows], bound)[0]
            good = score >= self.reach[i]
            hits.append((np.full(good.sum(), i), score[good], bucket.ids[rows[good]]))
        if hits:
            self.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))
        rest = np.flatnonzero(live & ~by_coordinate)
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            reach = self.reach[part]
            with np.errstate(divide="ignore"):
                need = np.where((reach > 0) & (bound < 2**53), reach / np.maximum(own.norms[part], 1e-300) * (1 - ROOM), -1.0)
            # lengths fall within a bucket, so those that are long enough are its first rows
            long = np.searchsorted(-bucket.norms, -need, side="right")
            n = int(long.max(initial=0))
            if not n:
                continue
            score = products(own.rows[part], bucket.rows[:n], bound)
            score[bucket.ids[None, :n] == own.ids[part][:, None]] = LEAST
            if n > self.k:
                reach = np.maximum(reach, np.partition(score, n - self.k, axis=1)[:, n - self.k])
            q, v = np.nonzero((score >= reach[:, None]) & (score > LEAST))
            self.add(part[q], score[q, v], bucket.ids[v])


def blocks_of(rows: pd.DataFrame) -> Iterator[tuple[int, Block]]:
    for r in rows.sort_values("place").itertuples():
        yield r.place, Block(r.ids, r.rows, r.norms, r.kind, r.width)


def usable(vector: Column, scale: float) -> Column:
    """Whether all components are there and finite, also when scaled."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))), F.lit(False))


def nearest(candidates: DataFrame, is_query: Column, k: int = 10, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id>, score``: the ``k`` largest inner products of each query among all rows but its own.

    Queries are the rows of ``candidates`` for which ``is_query`` holds. Components are floor(scale * x); scores are their
    exact integer inner products. Ties go to the smaller id. With fewer than ``k`` other rows, all are given.

    1. Vectors are put in the order of their lengths and packed into buckets of neighbours, queries into blocks.
    2. The bucket of the longest vectors gives every query a first score to reach.
    3. Cells of some buckets and query blocks search on their own: a bucket's local threshold for a query is the cosine
       that its longest vector would need. Above 1, the bucket and all shorter ones are left out; from
       ``COORDINATES_FROM`` on, coordinates that lie too far from the query's prune; else lengths do. What is left is
       multiplied out, exactly, and raises what is to be reached in the buckets that follow.
    4. A query's best of all cells are ranked, with the limit applied before the shuffle.

    Cells are cut by counts of rows, so a frequent vector or length fills buckets like any other. Rounding only ever
    keeps a candidate that might be left out.

    Rows without an id, a vector, or with a null or non-finite component take no part. A vector shorter than others
    counts as ending in zeros, so an empty one scores 0. All rows that have the query's id are its own; a repeated query
    row has its own results, and repeated candidates have a rank each. Scores beyond 64 bits are cut off there. Other
    columns aren't read. An empty table gives an empty result.
    """
    spark = candidates.sparkSession
    vector = F.col(f"`{vector_col}`")
    read = candidates.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("embedding"), scale))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale)))
    ready = cut(read.withColumn("length", length), "search-vectors")
    n, asked, width = ready.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).head()
    size = max(1, BUCKET_COMPONENTS // max(1, width))
    buckets, blocks = -(-n // size), -(-asked // QUERIES_A_BLOCK)
    across = max(1, min(CELL_BUCKETS, buckets // spark.sparkContext.defaultParallelism))
    rows_of, columns_of = -(-buckets // across), -(-blocks // CELL_BLOCKS)

    def as_blocks(df: DataFrame, per: int, label: str) -> DataFrame:
        dealt = df.select("id", "embedding", F.floor(F.col("__index") / per).alias("block"), "__index")
        return cut(dealt.groupBy("block").applyInPandas(lambda rows: packed(rows.sort_values("__index"), scale, width, "id"), BLOCK), label)

    ordered = indexed(ready.select("id", "embedding", "length"), [F.desc("length"), F.col("id")], None, "search-ordered")
    targets = as_blocks(ordered, size, "search-buckets")
    asks = as_blocks(indexed(cut(ready.filter("asks").select("id", "embedding"), "search-asking"), [F.col("id")], None, "search-asked"), QUERIES_A_BLOCK, "search-queries")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                found = Found(Block(r.ids, r.rows, r.norms, r.kind, r.width), np.full(len(r.ids) // 8, LEAST), k)
                found.search(Block(r.t_ids, r.t_rows, r.t_norms, r.t_kind, r.width))
                yield pd.DataFrame([(r.place, r.kind, r.width, r.ids, r.rows, r.norms, found.reach.astype("<i8").tobytes())], columns=[*(c.split()[0] for c in BLOCK.split(", ")), "reach"])

    # one bucket, whose size is bounded
    longest = targets.filter("place = 0").select(*[F.col(c).alias(f"t_{c}") for c in ("ids", "rows", "norms", "kind")])
    begun = cut(asks.join(F.broadcast(longest)).mapInPandas(first, f"{BLOCK}, reach binary"), "search-begun")

    def cell(buckets_of: pd.DataFrame, queries_of: pd.DataFrame) -> pd.DataFrame:
        found = [(place, Found(b, np.frombuffer(reach, "<i8"), k)) for (place, b), reach in zip(blocks_of(queries_of), queries_of.sort_values("place")["reach"], strict=True)]
        buckets = [b for _, b in blocks_of(buckets_of)]
        longest = np.maximum.accumulate([b.norms.max(initial=0) for b in buckets][::-1])[::-1]  # of a bucket and those behind it
        for _, f in found:
            for bucket, length in zip(buckets, longest, strict=True):
                if not f.open_to(length).any():
                    break
                f.search(bucket)
        out = [pd.DataFrame({"ask": place * QUERIES_A_BLOCK + f.rows[0], "query_id": f.queries.ids[f.rows[0]], "id": f.rows[2], "score": f.rows[1]}) for place, f in found]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("ask", "query_id", "id", "score")})

    def dealt(df: DataFrame, per: int, own: str, other: str, n: int) -> DataFrame:
        return df.select("*", F.floor(F.col("place") / per).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))).alias(other))

    left, right = dealt(targets, across, "r", "c", columns_of), dealt(begun, CELL_BLOCKS, "c", "r", rows_of)
    searched = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(cell, "ask long, query_id long, id long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    best = searched.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
