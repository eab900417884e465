"""Near-duplicates by SetSketch: banded registers, joint likelihood estimates, then confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.llm.text import U, lower, mix, shingle_hashes, slices, utf8, word_hashes, words
from tableweave.plans.materialize import cut, dropped, hinted

#: A pair of similarity 0.75 shares none of the bands with probability (1 - 0.75**4)**40, 3 in 10 million.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Registers hold floor(1 - log_b(minimum)) of values of rate A, truncated to 0..65535.
B, A = 1.001, 20.0
FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=U), 0xBEEF) | U(1)
SHINGLE = 5
#: Pairs whose estimate is below are not looked at again: more than four standard deviations under the threshold.
LEAST_ESTIMATE = 0.6
#: In a bucket's pairs, cheaply looked at first: a pair of similarity 0.75 has 120 equal registers give or take 5.5.
LEAST_EQUAL = REGISTERS // 2
PERCENT = 75
#: Buckets of more members, or of more shingles in all, are dealt again by their other bands.
BUCKET, SHINGLES = 2048, 4_000_000
#: Bytes of texts that a task holds before it settles the buckets it has whole.
HELD_BYTES = 64 << 20
#: A table of keys alone is broadcast up to this many rows (16 MB or so); beyond, the same join is a shuffle.
KEYS = 1_000_000
#: Likely pairs of a task that are confirmed at once.
PAIRS = 50_000
BLOCK_VALUES = 1 << 16


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        part = lower(data[offsets[a] : offsets[b]])
        starts, ends, counts = words(part, offsets[a : b + 1])
        yield from shingle_hashes(word_hashes(part, starts, ends), counts, k)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    low, high = mix(values, 11).sum(dtype=U), mix(values, 12).sum(dtype=U)
    return tuple(mix(np.array([low, high], dtype=U) + U(len(values)), 13).view(np.int64).tolist())


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SetSketch registers a set, none of them empty.

    Register i is the truncated logarithm of the least of the values that hash i gives the elements, exponentially
    distributed: the maximum of two sets' registers is the register of their union.
    """
    out = np.empty((len(sets), REGISTERS), dtype=U)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (n == 0 or n + len(sets[to]) <= BLOCK_VALUES):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        room = np.empty_like(x)
        for i in range(REGISTERS):
            np.multiply(x, FACTORS[i], out=room)
            out[at:to, i] = np.minimum.reduceat(room, begin)
        at = to
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(rows, BANDS): a key for each band of registers."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(U)
    joined = (parts << (np.arange(ROWS, dtype=U) * U(16))).sum(axis=2, dtype=U)
    return mix(mix(joined, 21) + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15), 22)


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity, from how many registers of a are above, below and equal to those of b and the set sizes.

    With u and v the shares of the sizes, a register of a is above with probability p(u - vJ) and below with p(v - uJ),
    where p(x) = -log_b(1 - x (b - 1) / b). The likelihood is concave in J on [0, min(u/v, v/u)].
    """
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + equal * np.log(np.clip(1 - more - less, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(a) > likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


# ---- stages


def _sketched(own: DataFrame) -> DataFrame:
    """``id, key, n, c1, c2, sketch`` of each row of ``id, key, text``; the sketch is null where the set is empty."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = list(shingle_sets(batch.column(2)))
                full = [s for s in sets if len(s)]
                sketches = iter(registers(full)) if full else iter(())
                digests = [set_digest(s) for s in sets]
                columns = [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()), pa.array([next(sketches).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return own.select("id", "key", "text").mapInArrow(run, "id long, key long, n long, c1 long, c2 long, sketch binary")


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _keys(regs: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """(rows, BANDS): the buckets that members of the bucket ``parent`` are dealt to (0: all rows)."""
    return mix(band_keys(regs) + parent.astype(np.int64).view(U)[:, None], 31)


def _dealt(rows: DataFrame) -> DataFrame:
    """``band, parent, node`` for each band of ``parent, node, sketch``, but the one that the parent is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, regs = batch.column(0).to_numpy(), _registers_of(batch.column(2))
            fresh = _keys(regs, np.zeros_like(parent)).view(np.int64) != parent[:, None]
            spread = lambda x: np.broadcast_to(x[:, None], fresh.shape)[fresh]
            columns = [_keys(regs, parent).view(np.int64)[fresh], spread(parent), spread(batch.column(1).to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "parent", "node"])

    return rows.select("parent", "node", "sketch").mapInArrow(run, "band long, parent long, node long")


def _buckets(dealt: DataFrame) -> DataFrame:
    """``band, parent, node, first, size`` of buckets with several members."""
    many = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last"))
    # a table of its own, so that the join has nothing but its shuffles under it and Spark can split a large bucket
    kept = cut(many.filter("size > 1 AND first < last").drop("last"), "near-keys")
    buckets = cut(dealt.join(kept, "band"), "near-buckets")
    dropped(kept)
    return buckets


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose joint estimate reaches LEAST_ESTIMATE."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _registers_of(batch.column(2)), _registers_of(batch.column(3))
                sizes = [batch.column(c).to_numpy().astype(float) for c in (4, 5)]
                likely = pa.array(estimate((x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1), *sizes) >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(likely), batch.column(1).filter(likely)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    return both.mapInArrow(run, "a long, b long")


def _within(members: DataFrame, own: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` between different components inside each bucket of ``deal, band, parent, node, label``.

    A bucket's members come with their texts. A pair is looked at in the first bucket that both are dealt to alone. What
    the registers leave likely is confirmed on the full sets there and then, unless the two are by now connected in this
    bucket: a bucket gives fewer links than it has members. ``members`` holds buckets of bounded size.
    """

    def settle(table: pa.Table) -> list[tuple[int, int]]:
        table = table.combine_chunks()
        sets = list(shingle_sets(table.column("text").combine_chunks()))
        full = np.array([k for k, x in enumerate(sets) if len(x)], dtype=np.int64)
        if len(full) < 2:
            return []
        sets, sizes, regs = [sets[k] for k in full], np.array([len(sets[k]) for k in full], dtype=float), registers([sets[k] for k in full])
        deals, bands, parents, nodes, labels = (table.column(c).to_numpy()[full] for c in ("deal", "band", "parent", "node", "label"))
        top, keys = _keys(regs, np.zeros_like(parents)).view(np.int64), _keys(regs, parents).view(np.int64)
        is_parent, is_own = top == parents[:, None], keys == bands[:, None]
        edges = [0, *(np.flatnonzero(deals[1:] != deals[:-1]) + 1).tolist(), len(deals)]
        bucket = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        known = np.unique(np.stack([bucket, labels]), axis=1, return_inverse=True)[1].ravel()  # components, apart for each bucket
        root = list(range(len(known)))
        links: list[tuple[int, int]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def confirm() -> None:
            """The likeliest pairs first, so that most of the others are connected when their turn comes."""
            if not pairs:
                return
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            pairs.clear()
            x, y = regs[i], regs[j]
            likely = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1), sizes[i], sizes[j])
            order = np.argsort(-likely)[: int((likely >= LEAST_ESTIMATE).sum())]
            for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
                u, v = find(known[p]), find(known[q])
                if u != v and similar(sets[p], sets[q]):
                    links.append((int(nodes[p]), int(nodes[q])))
                    root[v] = u

        waiting = 0
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for i in range(lo, hi - 1):
                other = i + 1 + np.flatnonzero(known[i + 1 : hi] != known[i])
                if not len(other):
                    continue
                other = other[(regs[other] == regs[i]).sum(axis=1) >= LEAST_EQUAL]
                other = other[(100 * np.minimum(sizes[other], sizes[i]) >= PERCENT * np.maximum(sizes[other], sizes[i])) & (nodes[other] != nodes[i])]
                if not len(other):
                    continue
                shared = top[other] == top[i]
                here = (is_parent if parents[i] else is_own)[i][shared.argmax(axis=1)]
                if parents[i]:  # dealt again: pairs that the parent is the first bucket of, in the first one but it
                    here &= is_own[i][((keys[other] == keys[i]) & ~is_parent[i]).argmax(axis=1)]
                other = other[here]
                pairs.append((np.full(len(other), i), other))
                waiting += len(other)
                if waiting >= PAIRS:
                    confirm()
                    waiting = 0
        confirm()
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        rows = held = 0

        def told(table: pa.Table) -> pa.RecordBatch:
            links = settle(table)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for whole in batches:
            for k in range(0, whole.num_rows, BUCKET):
                rest.append(whole.slice(k, BUCKET))
                rows += rest[-1].num_rows
                held += rest[-1].nbytes
                if rows < BUCKET and held < HELD_BYTES:
                    continue
                table = pa.Table.from_batches(rest)
                deals = table.column("deal").to_numpy()
                ready = int(np.flatnonzero(deals == deals[-1])[0])  # the last bucket may go on
                if ready:
                    yield told(table.slice(0, ready))
                rest, rows = table.slice(ready).to_batches(), table.num_rows - ready
                held = sum(x.nbytes for x in rest)
        if rows:
            yield told(pa.Table.from_batches(rest))

    nodes = cut(members.select("node").distinct(), "near-nodes")
    # few texts are in mixed buckets: the others go before anything is shuffled
    texts = own.select(F.col("key").alias("node"), "text").join(hinted(nodes, KEYS), "node", "left_semi")
    # members grow with the corpus, so this is a shuffle at every size
    rows = texts.join(members, "node").select("deal", "band", "parent", "node", "label", "text")
    # little text, much work: as many tasks as the session's, whatever their bytes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut(rows.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, "a long, b long").distinct(), "near-links")
    dropped(nodes)
    return links


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold; empty ones never do."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= PERCENT * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. Two texts at a time are in memory, besides the Arrow batch."""
    sides = cut(pairs.distinct(), "near-pairs")
    keys = cut(sides.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-keys")
    texts = own.select("key", "text").join(hinted(keys, KEYS), "key", "left_semi")
    both = texts.join(sides.select("a", "b", F.explode(F.array("a", "b")).alias("key")), "key")
    dealt = both.select("a", "b", "key", "text").repartition("a", "b").sortWithinPartitions("a", "b", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets, linked = None, {}, False
        for batch in batches:
            out = []
            for i, (a, b, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (a, b) != last:
                    last, sets, linked = (a, b), {a: []}, False
                (mine,) = shingle_sets(batch.column(3).slice(i, 1))
                if key == a:
                    sets[a].append(mine)
                elif not linked:
                    linked = any(similar(x, mine) for x in sets[a])
                    if linked:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    links = cut(dealt.mapInArrow(run, "a long, b long"), "near-links")
    dropped(sides, keys)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` links that isn't the least of its component.

    Alternating large-star and small-star steps: nodes hand their neighbours to the least one they know, until nothing
    changes, which takes a number of rounds logarithmic in the nodes. Each round is written to the shared folder.
    """

    def size(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "near-edges")
    now = size(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        last, edges = edges, cut(small.select("e.u", F.col("e.m").alias("v")).filter("u > v").distinct(), "near-edges")
        dropped(last)
        before, now = now, size(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _mixed(buckets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that lie in several components: ``band, parent, node, label, size, load`` (shingles in all)."""
    told = cut(buckets.join(labels, "node", "left").select("band", "parent", "node", "size", F.coalesce("label", "node").alias("label")), "near-told")
    kinds = cut(told.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("band"), "near-kinds")
    mixed = cut(told.join(kinds, "band", "left_semi").join(classes.select("node", "n"), "node"), "near-mixed")
    loads = mixed.groupBy("band").agg(F.sum("n").alias("load"))
    sized = cut(mixed.join(loads, "band").drop("n"), "near-sized")
    dropped(told, kinds, mixed)
    return sized


def _stars(members: DataFrame) -> DataFrame:
    """For each node one pair, with the least node of a bucket that it meets most often."""
    met = members.filter("node <> first").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", "first")).alias("best"))
    return best.select(F.col("best.first").alias("a"), F.col("node").alias("b"))


def _fits() -> Column:
    return (F.col("size") <= BUCKET) & (F.col("load") <= SHINGLES)


def _small(mixed: DataFrame) -> DataFrame:
    return mixed.filter(_fits()).withColumn("deal", F.col("band"))


def _in_blocks(large: DataFrame) -> DataFrame:
    """Members of buckets that are still large, as buckets of two blocks each: every pair of members shares one."""
    n = F.ceil(2 * F.greatest(F.col("size") / BUCKET, F.col("load") / SHINGLES)).cast("long")
    mine = large.withColumn("mine", F.pmod(F.xxhash64("node"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return mine.withColumn("deal", F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")))


def _components_of(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without their sketches, classes ``c1, c2, node`` of rows with equal sets, and labels of nodes."""
    sketched = cut(_sketched(own), "near-sketches")
    grouped = sketched.filter("n > 0").groupBy("c1", "c2").agg(F.min("key").alias("node"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(grouped, "near-classes")
    rows, names = cut(sketched.drop("sketch"), "near-rows"), cut(classes.select("c1", "c2", "node"), "near-names")
    dropped(sketched)
    buckets = _buckets(_dealt(classes.select(F.lit(0).cast("long").alias("parent"), "node", "sketch")))
    # one center for each: most members of a bucket of near copies are now in one component
    labels = components(_confirmed(_likely(_stars(buckets), classes), own))
    mixed = _mixed(buckets, labels, classes)
    dropped(buckets)
    labels = _joined(labels, _within(_small(mixed), own))
    large = mixed.filter(~_fits())
    if not large.isEmpty():
        parents = large.select(F.col("band").alias("parent"), "node").join(classes.select("node", "sketch"), "node")
        buckets = _buckets(_dealt(parents))
        again = _mixed(buckets, labels, classes)
        dropped(buckets)
        labels = _joined(labels, _within(_small(again), own))
        large = again.filter(~_fits())
        if not large.isEmpty():
            labels = _joined(labels, _within(_in_blocks(large), own))
        dropped(again)
    dropped(mixed, classes)
    return rows, names, labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links."""
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


#: Names of rows without an id lie above every id.
NAMELESS = 1 << 62


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), _key(id_col, text_col).alias("key"), text.alias("text"))


def _key(id_col: str, text_col: str) -> Column:
    nameless = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2) + F.lit(NAMELESS)
    return F.coalesce(F.col(id_col).cast("long"), nameless)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``<id>, n_shingles, component_id, kept``.

    Texts are linked when their sets of distinct 5-word shingles (A-Z lower-cased; all words where there are fewer than
    five) have 100 * intersection >= 75 * union; ``component_id`` is the least id reachable over links, and that row is
    kept. Texts without words are linked with nothing. Rows with equal sets are one class, whatever their number.

    Rows without an id are named by their texts: a component of such rows alone has a null id and all of it says kept.
    Ids should be unique; a repeated id counts as a row of its own for each text. Extra columns are not read.

    Candidates meet in bands of SetSketch registers. A bucket's members are first compared with one center each; only
    buckets that then still hold several components are looked at pair by pair, across components, and large ones are
    first dealt again by their other bands. All candidate links are confirmed on full sets.
    """
    own = _own(docs, id_col, text_col)
    rows, classes, labels = _components_of(own)
    told = rows.join(classes, ["c1", "c2"], "left").join(labels, "node", "left")
    root = F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("id"))
    component = F.when(root < NAMELESS, root)
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component (that of the least id), all their columns unchanged.

    Texts without words all stay. Of repeated rows with one id and one set, one stays; rows with one id and different sets
    are decided each for itself.
    """
    own = _own(docs, id_col, text_col)
    rows, classes, labels = _components_of(own)
    told = rows.filter("n > 0").join(classes, ["c1", "c2"]).join(labels, "node", "left")
    gone = told.filter(F.col("key") != F.coalesce("label", "node")).select("key", "c1", "c2").distinct()
    twice = rows.filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    twice = cut(twice, "near-twice")
    # a key that only one row has names that row; where several have it, their sets tell them apart
    alone = cut(gone.join(twice, "key", "left_anti").select(F.col("key").alias("__key")), "near-gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(_key(id_col, text_col).alias("__key"), row)
    stay = keyed.join(hinted(alone, KEYS), "__key", "left_anti")
    marked = stay.join(hinted(twice.withColumnRenamed("key", "__key"), KEYS), "__key", "left")
    once = marked.filter("copies IS NULL").select("__row.*")
    if twice.isEmpty():
        return once
    text = F.coalesce(F.col(f"__row.`{text_col}`"), F.lit(""))
    more = marked.filter("copies > 1").select("__key", "__row", F.xxhash64(text).alias("__hash"), text.alias("__text"))
    sets = _sketched(more.select(F.col("__hash").alias("id"), F.col("__key").alias("key"), F.col("__text").alias("text"))).drop("sketch").distinct()
    named = more.drop("__text").join(sets, (F.col("__key") == F.col("key")) & (F.col("__hash") == F.col("id")))
    left = named.join(gone, ["key", "c1", "c2"], "left_anti")
    return once.unionByName(left.filter("n = 0").select("__row.*")).unionByName(left.filter("n > 0").dropDuplicates(["key", "c1", "c2"]).select("__row.*"))
