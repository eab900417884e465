"""Removal of repeated byte strings: suffixes sorted bucket by bucket, long ties resolved by difference-cover names.

A suffix array of the whole corpus would need a row a byte. Only suffixes whose first ``window`` bytes occur again matter,
so the buckets are made of those that can: of the SEED-byte strings in a window the one of least hash is its anchor, and
equal windows have equal anchors at equal places. A window whose anchor occurs once in the corpus can't repeat.

1. Anchors are counted; those that occur once go. An anchor's context is the union of all windows around it; contexts that
   are equal as a whole settle all their windows at once.
2. What is left are anchors with several different contexts. Each is a bucket of suffixes; ``sort_bucket`` sorts those that
   begin d bytes before the anchor. Suffixes are compared by their first COVER bytes, then by ranks of sampled places that
   were sorted before, then by the bytes those ranks don't reach. The sample is a difference cover modulo COVER: any two
   places have a common distance below COVER at which both are in the sample, so a comparison costs the same however long
   the tie is, and memory is that of one block of contexts with a sample of its places.
3. Buckets of more than HOT contexts don't fit one task. They are dealt out by longer prefixes: windows of a range of
   distances share a core, cores are counted with map-side combining, and windows with a repeated core are counted in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableweave.llm.text import LETTERS, U, mix, prefix_hash, span_hash, utf8
from tableweave.plans.materialize import cut, dropped

WINDOW, SEED = 200, 50
COVER = 32
#: Contexts of an anchor that are gathered in one task at most, and contexts that are sorted at once (but whole buckets).
HOT, BLOCK = 512, 8192
#: Distances that share a core in a hot bucket.
STEP = 16
CHUNK = 1 << 20
KEEP_HASH, KEEP_PLACE = U(0xFFFFFFFFF0000000), U(0x0FFFFFFF)

ANCHORS = "anchor long, context long, id long, tag int, at int, reach int"


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo v is one between two of them, chosen greedily."""
    cover, seen = [0], {0}
    while len(seen) < v:
        best = max(range(v), key=lambda x: len({(x - c) % v for c in cover} | {(c - x) % v for c in cover} | seen))
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return np.array(sorted(set(cover)))


def common_shifts(cover: np.ndarray, v: int) -> np.ndarray:
    """shift[a, b]: the least distance at which positions of residues a and b are both in the sample."""
    member = np.isin(np.arange(2 * v) % v, cover)
    a = np.arange(v)[:, None, None] + np.arange(v)
    return np.argmax(member[a] & member[np.arange(v)[None, :, None] + np.arange(v)], axis=2)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in the row, anchor, context, bytes to the left, bytes to the right) in chunks of the joined rows.

    ``data`` begins at offsets[0]. Memory depends on CHUNK alone, however long a row is.
    """
    ends_all, total = offsets - offsets[0], len(data)
    reach, last = window - seed, -1
    for c0 in range(0, max(total - window + 1, 0), CHUNK):
        c1 = min(c0 + CHUNK, total - window + 1)
        b0, b1 = max(0, c0 - reach), min(total, c1 + window + reach)
        h = prefix_hash(LETTERS[data[b0:b1]])
        first = c0 - b0
        starts = np.arange(first, c1 - b0 + window - seed)
        grams = mix(span_hash(h, starts, starts + seed))
        least = sliding_min((grams & KEEP_HASH) | np.arange(len(grams), dtype=U), window - seed + 1)
        where = np.arange(c0, c1)
        row = np.searchsorted(ends_all, where, side="right") - 1
        whole = where + window <= ends_all[row + 1]
        found = np.unique((least[whole] & KEEP_PLACE).astype(np.int64)) + c0
        found = found[found > last]
        if not len(found):
            continue
        last = int(found[-1])
        row = np.searchsorted(ends_all, found, side="right") - 1
        left = np.minimum(found - ends_all[row], reach)
        right = np.minimum(ends_all[row + 1] - found, window)
        context = mix(span_hash(h, found - left - b0, found + right - b0) + (left * 1024 + right).astype(U), 7)
        yield row, found - ends_all[row], grams[found - c0], context, left, right


# ---- sorting a bucket


def refined(words: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, in the order of bytes, of the strings of ``depth`` bytes at ``place``; equal strings share one.

    ``words`` has the eight bytes from each place on as a number. Ties of the words so far are ordered by their next word.
    """
    rank, open_ = np.zeros(len(place), dtype=np.int64), np.arange(len(place))
    for k in range(0, depth, 8):
        if not len(open_):
            break
        word = words[place[open_] + min(k, depth - 8)]
        order = np.lexsort((word, rank[open_]))
        open_, word = open_[order], word[order]
        old, at = rank[open_], np.arange(len(open_))
        start = np.concatenate([[True], old[1:] != old[:-1]])
        first = start | np.concatenate([[True], word[1:] != word[:-1]])
        rank[open_] = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        open_ = open_[~(first & np.concatenate([first[1:], [True]]))]
    return rank


def cover_ranks(text: np.ndarray, words: np.ndarray, cover: np.ndarray, depth: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each sampled place between a begin and its end the rank of the ``depth`` bytes from there on among those of all.

    Repeats of one string, found by a hash and then compared byte by byte, are sorted once.
    """
    inside = np.zeros(len(text) + 1, dtype=np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    place = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[:-1] > 0)
    place = place[np.isin(place % COVER, cover)]
    ranks = np.zeros(len(text) + COVER, dtype=np.int64)
    h = prefix_hash(LETTERS[text])
    _, one, which = np.unique(span_hash(h, place, place + depth), return_index=True, return_inverse=True)
    lead = place[one][which]
    twice = place != lead
    if all((words[place[twice] + k] == words[lead[twice] + k]).all() for k in range(0, depth, 8)):
        ranks[place] = refined(words, place[one], depth)[which]
    else:
        ranks[place] = refined(words, place, depth)
    return ranks


def sort_bucket(text: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, window: int = WINDOW, seed: int = SEED):
    """For each context the largest and least distance d at which its window occurs in another context of its group.

    ``text``: the contexts one after the other, then at least ``window`` more bytes; context i begins at start[i] and its
    anchor stands ``left[i]`` bytes further, with ``right[i]`` bytes from there on. -1 where no window of it occurs again.
    """
    cover, depth = difference_cover(COVER), window - COVER
    shifts = common_shifts(cover, COVER)
    words = np.ndarray((len(text) - 7,), dtype=">u8", buffer=text, strides=(1,)).astype(U)
    ranks = cover_ranks(text, words, cover, depth, start, start + left + COVER)
    most, least = np.full(len(start), -1), np.full(len(start), len(text) + window)
    group = np.unique(group, return_inverse=True)[1]
    for d0 in range(0, window - seed + 1, STEP):
        d = np.arange(d0, min(d0 + STEP, window - seed + 1))
        rows, nth = np.nonzero((left[:, None] >= d) & (right[:, None] >= window - d))
        bucket = group[rows] * len(d) + nth
        again = _repeated(start[rows] + left[rows] - d[nth], bucket, words, ranks, shifts, depth, window)
        np.maximum.at(most, rows[again], d[nth[again]])
        np.minimum.at(least, rows[again], d[nth[again]])
    return most, np.where(most < 0, -1, least)


def _repeated(p: np.ndarray, bucket: np.ndarray, words: np.ndarray, ranks: np.ndarray, shifts: np.ndarray, depth: int, window: int) -> np.ndarray:
    """Which suffixes (at p) agree with another of their bucket in their first ``window`` bytes.

    Buckets are sorted by their first word; ties are then sorted by comparison with the first of each, which splits a tie
    in the less and the greater ones, all ties at once, until they are singles.
    """
    again = np.zeros(len(p), dtype=bool)
    head = words[p]
    order = np.lexsort((head, bucket))
    first = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (head[order][1:] != head[order][:-1])]) if len(p) else np.zeros(0, bool)
    while len(order):
        tied = ~(first & np.concatenate([first[1:], [True]]))
        order, first = order[tied], first[tied]
        if not len(order):
            break
        lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rest = np.flatnonzero(~first)
        sign = _compared(p[order[rest]], p[order[lead[rest]]], words, ranks, shifts, depth, window)
        same = rest[sign == 0]
        again[order[same]] = True
        again[order[lead[same]]] = True
        rest, sign = rest[sign != 0], sign[sign != 0]
        side = 2 * lead[rest] + (sign > 0)
        by = np.argsort(side, kind="stable")
        order, side = order[rest[by]], side[by]
        first = np.concatenate([[True], side[1:] != side[:-1]]) if len(side) else np.zeros(0, bool)
    return again


def _compared(p: np.ndarray, q: np.ndarray, words: np.ndarray, ranks: np.ndarray, shifts: np.ndarray, depth: int, window: int) -> np.ndarray:
    """-1, 0 or 1 as the ``window`` bytes at p come before, equal or come after those at q; their first words are equal.

    Words up to the modulus of the cover, then the ranks at the first distance at which both are in the sample, then the
    words that those ranks don't reach.
    """
    sign, open_ = np.zeros(len(p), dtype=np.int8), np.arange(len(p))

    def told(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal open_, p, q
        differ = a != b
        if differ.any():
            sign[open_[differ]] = np.where(a[differ] < b[differ], -1, 1)
            open_, p, q = open_[~differ], p[~differ], q[~differ]

    for k in range(8, COVER, 8):
        told(words[p + k], words[q + k])
    shift = shifts[p % COVER, q % COVER]
    told(ranks[p + shift], ranks[q + shift])
    for k in range(depth, window, 8):
        at = min(k, window - 8)
        told(words[p + at], words[q + at])
    return sign


def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: (anchor, id, tag, at, single, left, bytes); the spans that single contexts lose."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def settle(table: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8_binary(table.column("bytes").combine_chunks())
        left = table.column("left").to_numpy().astype(np.int64)
        text = np.concatenate([data, np.zeros(2 * WINDOW, np.uint8)])
        start = (offsets[:-1] - offsets[0]).astype(np.int64)
        right = np.diff(offsets) - left
        most, least = sort_bucket(text, start, left, right, table.column("anchor").to_numpy())
        hit = (most >= 0) & table.column("single").to_numpy(zero_copy_only=False)
        at = table.column("at").to_numpy()[hit].astype(np.int64)
        return spans_batch(table.column("id").filter(pa.array(hit)), table.column("tag").filter(pa.array(hit)), at - most[hit], at + WINDOW - least[hit])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("anchor").to_numpy()
        ready = int(np.searchsorted(keys, keys[-1], side="left"))  # the last bucket may go on
        if ready:
            yield settle(table.slice(0, ready))
        held = table.slice(ready).to_batches()
        rows = table.num_rows - ready
    if rows:
        yield settle(pa.Table.from_batches(held))


def utf8_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets


def spans_batch(ids, tags, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, tags)]
    return pa.RecordBatch.from_arrays([*flat, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "tag", "lo", "hi"])


SPANS = "id long, tag int, lo int, hi int"


# ---- the job


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for row, at, anchor, context, left, right in anchors_of(data[offsets[0] : offsets[-1]], offsets):
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own),
                        pa.array(at.astype(np.int32)), pa.array((left * 1024 + right).astype(np.int32)),
                    ],
                    names=["anchor", "context", "id", "tag", "at", "reach"],
                )

    return docs.select("id", "tag", "text").mapInArrow(run, ANCHORS)


def _with_texts(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    on = docs["id"].eqNullSafe(listed["id"]) & (docs["tag"] == listed["tag"])
    return docs.join(listed, on, how).select(docs["id"], docs["tag"], "text", "list")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted contexts. A repeated row gives its contexts once for each repeat; one is enough."""
    listed = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "single", "at", "reach", "hot")).alias("list"))
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("single", pa.bool_()), ("hot", pa.bool_()), ("left", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(k, 256), []
                for doc, tag, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = text.encode()
                    for x in items:
                        left, right = divmod(x["reach"], 1024)
                        rows.append((x["anchor"], doc, tag, x["at"], x["single"], x["hot"], left, data[x["at"] - left : x["at"] + right]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _with_texts(docs, listed, "inner").mapInArrow(run, "anchor long, id long, tag int, at int, single boolean, hot boolean, left int, bytes binary")


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Spans of contexts in hot buckets, by counts of cores and then of windows; no bucket meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                data, offsets = utf8_binary(batch.column("bytes"))
                h = prefix_hash(LETTERS[data])
                left = batch.column("left").to_numpy().astype(np.int64)
                anchor = (offsets[:-1] - offsets[0]).astype(np.int64) + left
                right = np.diff(offsets) - left
                for d0 in range(0, WINDOW - SEED + 1, STEP):
                    ds = np.arange(d0, min(d0 + STEP, WINDOW - SEED + 1))
                    fine = (left[:, None] >= ds) & (right[:, None] >= WINDOW - ds)
                    rows = np.flatnonzero(fine.any(axis=1))
                    if not len(rows):
                        continue
                    # the core is what all windows of the range have in common, so far as the row's windows are whole
                    core = mix(span_hash(h, anchor[rows] - d0, anchor[rows] + WINDOW - int(ds[-1])) + U(d0 + 1), 3)
                    begin = np.where(fine[rows], anchor[rows][:, None] - ds, 0)
                    each = mix(span_hash(h, begin.ravel(), begin.ravel() + np.where(fine[rows].ravel(), WINDOW, 0)), 5).reshape(begin.shape).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fine[rows].sum(axis=1))]).astype(np.int32)), pa.array(each[fine[rows]]))
                    offs = pa.array(np.argmax(fine[rows], axis=1).astype(np.int32) + d0)
                    own = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(own) for c in ("anchor", "id", "tag", "at", "single")), pa.array(core.view(np.int64)), offs, lists],
                        names=["anchor", "id", "tag", "at", "single", "core", "d", "windows"],
                    )

    cores = cut(contexts.mapInArrow(run, "anchor long, id long, tag int, at int, single boolean, core long, d int, windows array<long>"), "suffix-cores")
    again = cores.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "core")
    each = cores.join(again, ["anchor", "core"], "left_semi").select("anchor", "id", "tag", "at", "single", "d", F.posexplode("windows").alias("k", "w"))
    each = cut(each.select("anchor", "id", "tag", "at", "single", (F.col("d") + F.col("k")).alias("d"), "w"), "suffix-windows")
    twice = each.groupBy("anchor", "d", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "d", "w")
    hits = each.filter("single").join(twice, ["anchor", "d", "w"], "left_semi")
    ends = hits.groupBy("anchor", "id", "tag", "at").agg(F.max("d").alias("most"), F.min("d").alias("least"))
    return ends.select("id", "tag", (F.col("at") - F.col("most")).alias("lo"), (F.col("at") + WINDOW - F.col("least")).alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``id, tag, lo, hi`` of byte spans that repeated windows cover, overlapping ones too; docs has ``id, tag, text``."""
    # written once, in the order of the documents: an anchor that many documents have lies in many files, so that the
    # joins below, which have nothing but their shuffles under them, can be split by Spark
    anchors = cut(_anchor_rows(docs), "suffix-anchors")
    many = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "suffix-repeated")
    found = cut(anchors.join(many, "anchor", "left_semi"), "suffix-found")
    grouped = found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "at", "reach")).alias("first"))
    contexts = cut(grouped.select("anchor", "context", "n", "first.*"), "suffix-contexts")
    dropped(many, found)
    twice = cut(contexts.filter("n > 1").select("anchor", "context"), "suffix-twice")
    same = anchors.join(twice, ["anchor", "context"], "left_semi")
    left, right = F.floor(F.col("reach") / 1024).cast("int"), (F.col("reach") % 1024).cast("int")
    settled = cut(same.select("id", "tag", (F.col("at") - left).alias("lo"), (F.col("at") + right).alias("hi")), "suffix-settled")
    dropped(anchors, twice)

    buckets = cut(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "suffix-buckets")
    wanted = contexts.join(buckets, "anchor").select("anchor", "id", "tag", "at", "reach", (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT).alias("hot"))
    pieces = cut(_contexts(docs, wanted), "suffix-pieces")
    dropped(contexts, buckets)
    cold = pieces.filter("NOT hot").select("anchor", "id", "tag", "at", "single", "left", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = cut(cold.mapInArrow(sorted_buckets, SPANS), "suffix-sorted")
    counted = cut(_hot_spans(pieces.filter("hot")), "suffix-counted")
    dropped(pieces)
    return settled.unionByName(sorted_).unionByName(counted)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``<id>, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay).

    Every byte that a 200-byte string covers which also starts elsewhere in any document goes, the first occurrence
    included; matches never cross documents, and they may overlap themselves. Null text is empty; texts under 200 bytes
    stay. A repeated row is another document with the same text, so it is removed as such. Null ids are as good as others.
    Other columns aren't read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    listed = repeated_spans(own).groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch, rows = whole.slice(k, 1024), []
                for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    data, at, parts = text.encode(), 0, []
                    runs = merged([(x["lo"], x["hi"]) for x in items or ()])
                    for lo, hi in runs:
                        parts.append(data[at:lo])
                        at = hi
                    parts.append(data[at:])
                    stay = b"".join(parts)
                    rows.append((doc, len(data), len(data) - len(stay), len(runs), hashlib.sha256(stay).hexdigest(), stay))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = _with_texts(own, listed, "left").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
