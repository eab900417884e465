"""Best-fit decreasing packing of token pieces, with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tableweave.plans.materialize import cut

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
ROWS_A_SALT = 100_000


class CapacityTree:
    """A segment tree over the remaining capacities 0..top: which of them any open bin has.

    ``tightest(size)`` gives the smallest such capacity of at least ``size``, or -1, in logarithmic time.
    """

    def __init__(self, top: int) -> None:
        self.width = 1 << top.bit_length()
        self.any = [False] * (2 * self.width)

    def set(self, capacity: int, has: bool) -> None:
        node = capacity + self.width
        self.any[node] = has
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, size: int) -> int:
        node = size + self.width
        if self.any[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return -1
        while node < self.width:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.width


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over how many pieces there are of each length.

    Pieces of a length are alike and so are bins of one remaining capacity, so a run of bins takes a run of pieces at
    once: the plan's size depends on the capacity alone, not on how many pieces there are. Rows are (length, rank of the
    first piece, pieces, first bin, pieces a bin, offset in the bin); the bins of a row are consecutive.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), {}, [], 0

    def give_back(room: int, run: tuple[int, int]) -> None:
        if room > 0 and run[1] > 0:
            open_bins.setdefault(room, deque()).append(run)
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, run = capacity, (bins, -(-left // (capacity // size)))
                bins += run[1]
            else:
                run = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            fit = room // size
            full = min(run[1], left // fit)
            if full:
                rows.append((size, rank, full * fit, run[0], fit, capacity - room))
                give_back(room - fit * size, (run[0], full))
                rank, left = rank + full * fit, left - full * fit
            rest = (run[0] + full, run[1] - full)
            if left and rest[1]:  # fewer pieces than one bin takes
                rows.append((size, rank, left, rest[0], left, capacity - room))
                give_back(room - left * size, (rest[0], 1))
                rest, left = (rest[0] + 1, rest[1] - 1), 0
            give_back(room, rest)
    return rows


def tokenizer(path: str, added_tokens: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Ids by a public byte-level BPE vocabulary file, as the tokenizers library gives them without added special tokens.

    For ``byte_bpe_50k.json`` beside its rank file, the rank file's library (tiktoken) is used: same ids, several times
    faster (a test compares them). Any other tokenizer.json goes through the tokenizers library. With ``added_tokens`` the
    vocabulary's added tokens, such as ``<|endoftext|>``, have their own ids where they stand in a text, as the library has
    it unless told otherwise; without, they are ordinary text.
    """
    import json
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(path, encoding="utf-8") as file:
            added = (json.load(file).get("added_tokens") or []) if added_tokens else []
        if not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            own = {t["content"]: t["id"] for t in added}
            coded = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=own)
            return lambda texts: [coded.encode(x, allowed_special="all") if any(t in x for t in own) else coded.encode_ordinary(x) for x in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = not added_tokens
    return lambda texts: [x.ids for x in loaded.encode_batch(texts, add_special_tokens=False)]


def cut_pieces(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``most`` ids but the first, which has what is left over."""
    first = n % most or most
    yield 0, first
    for start in range(first, n, most):
        yield start, most


def pieces_of(docs: DataFrame, path: str, most: int, end_id: int, id_col: str, text_col: str, added_tokens: bool = False) -> DataFrame:
    """Tokenised pieces of every row. Memory: one Arrow batch of texts and the ids of a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, added_tokens)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode([text.as_py() or ""])[0], end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut_pieces(len(ids), most)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            rows = list(zip(*out, strict=True)) or [()] * 5
            kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, PIECES.replace("doc_id long", f"doc_id {kind}"))


def pack(
    docs: DataFrame, tokenizer_path: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False
) -> DataFrame:
    """Every document's ids, then ``end_id``, packed into few sequences of at most ``most`` tokens.

    One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts are the end id
    alone. Added tokens of the vocabulary in a text: see ``tokenizer``. Only documents longer than ``most`` are cut. Repeated rows are packed as often as they occur. Extra columns are
    not read.

    The driver sees how many pieces there are of each length (at most ``most`` numbers), plans the bins by best fit
    decreasing, and hands back runs of bins. Ranking pieces of a length is by salted parts and their counts, so that no
    task holds a length's pieces: a third of the corpus may have the same one.
    """
    spark = docs.sparkSession
    pieces = cut(pieces_of(docs, tokenizer_path, most, end_id, id_col, text_col, added_tokens), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(counts, most)
    salts = max(16, -(-max(counts.values(), default=0) // ROWS_A_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    return place(ranked, plan, spark).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def place(ranked: DataFrame, plan: list[tuple[int, int, int, int, int, int]], spark) -> DataFrame:
    """Sequence and offset of each ranked piece, by the plan's run that holds its rank; the plan is broadcast (bounded)."""
    table = np.array(plan, dtype=np.int64).reshape(-1, 6)
    runs = spark.sparkContext.broadcast({int(k): table[table[:, 0] == k] for k in np.unique(table[:, 0])})

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            bins, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            length, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            for size in np.unique(length):
                rows, where = runs.value[int(size)], np.flatnonzero(length == size)
                row = rows[np.searchsorted(rows[:, 1], rank[where], side="right") - 1]
                nth = rank[where] - row[:, 1]
                bins[where] = row[:, 3] + nth // row[:, 4]
                at[where] = row[:, 5] + nth % row[:, 4] * size
            x["sequence_id"], x["offset"] = bins, at
            yield x[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(found, PIECES.replace("doc_id long", f"doc_id {kind}") + ", sequence_id long, offset long")
