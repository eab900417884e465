"""Encoding and decoding with a SentencePiece vocabulary: a streaming Viterbi search over the pieces' scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose ids a Python worker remembers, from task to task; a full memory is emptied. Longer ones hardly come again.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 64
#: Tabs and line feeds are never part of a piece (checked when a vocabulary is read).
CONTROL = r"\t\n"
PARTS = re.compile(rf"[{CONTROL}]|{BLANK}*[^{BLANK}{CONTROL}]+|{BLANK}+")


class Vocabulary:
    """Pieces, their scores, and bytes for what no piece has; read from a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.bytes_of, self.byte_id = {}, {}, [], {}
        self.unknown_id = model.unk_id()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        # pieces with their scores and ids, and what pieces begin with: a search ends where no piece goes on
        self.begins = {p[:k]: None for p in self.ids for k in range(1, len(p))} | {p: (x, (self.ids[p],)) for p, x in self.score.items()}
        self.known: dict[str, list[int]] = {}
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # where no piece goes on with a blank after another character, every path has a boundary before such a blank
        self.splits = not any(re.search(rf"[^{BLANK}]{BLANK}|[{CONTROL}]", p) for p in self.ids)

    def of_unknown(self, c: str) -> list[int]:
        if len(self.byte_id) < 256:
            return [self.unknown_id]
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stream(text: str, vocab: Vocabulary) -> Iterator[list[int]]:
    """Ids of the best-scoring segmentation, in commits as early as they are certain.

    A window holds for each open place its best score, where the last piece of its path began and that piece's ids; paths
    reach ahead by less than the longest piece. Where nothing reaches beyond a place, all paths end there; otherwise, once
    in a while, the last place that all of them go through is looked for. What leads to such a place is committed and leaves
    the window. Of equal scores the path whose last piece began first stays.
    """
    get, longest, n, nothing, unknown = vocab.begins.get, vocab.longest, len(text), (None,), vocab.unknown_score
    room = min(n, longest)  # the last place that the window has room for
    empty = [None] * room
    scores, came = [0.0, *empty], [None, *empty]
    first = reach = s = checked = 0  # places in the text: of the window's begin, the furthest open one, here, the last look
    while s < n:
        i, e = s - first, s + 1
        base, found = scores[i], get(text[s:e], nothing)
        if found is None or found is nothing:
            x, old = base + unknown, scores[i + 1]
            if old is None or x > old:
                scores[i + 1], came[i + 1] = x, (i, vocab.of_unknown(text[s]))
                if e > reach:
                    reach = e
        while found is not nothing:
            if found is not None:
                x, old = base + found[0], scores[e - first]
                if old is None or x > old:
                    scores[e - first], came[e - first] = x, (i, found[1])
                    if e > reach:
                        reach = e
            e += 1
            if e > n:
                break
            found = get(text[s:e], nothing)
        s += 1
        if s == n:
            break
        if reach == s:
            joint = s - first
        elif s - checked >= longest:
            joint, checked = _meeting(came, s - first, reach - first), s
        else:
            joint = 0
        if joint:
            yield _ids(came, joint)
            # scores are counted from the commit on, so that they stay exact in a text of any length
            low = scores[joint]
            scores = [None if x is None else x - low for x in scores[joint : reach - first + 1]]
            came = [None, *[None if c is None else (c[0] - joint, c[1]) for c in came[joint + 1 : reach - first + 1]]]
            first += joint
            room = first + len(scores) - 1
        if room < n and room < s + longest:
            short = min(s + longest, n) - room
            scores.extend([None] * short)
            came.extend([None] * short)
            room += short
    if s > first:
        yield _ids(came, s - first)


def _meeting(came: list, here: int, last: int) -> int:
    """The last place of the window that all open paths go through."""
    open_places = {k for k in range(here, last + 1) if came[k] is not None}
    while len(open_places) > 1:
        place = max(open_places)
        open_places.discard(place)
        open_places.add(came[place][0] if place else 0)
    return open_places.pop()


def _ids(came: list, place: int) -> list[int]:
    out = []
    while place:
        place, ids = came[place]
        out.append(ids)
    return [i for part in reversed(out) for i in part]


class Encoder:
    """Text to ids by ``stream``. Where the vocabulary guarantees a boundary before each word, all paths converge there:
    each word is a stream of its own, and what it gave is remembered for the next time it comes."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.known = vocab, vocab.known

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = BLANK + text.replace(" ", BLANK)
        if not self.vocab.splits:
            return [i for part in stream(marked, self.vocab) for i in part]
        out: list[int] = []
        known = self.known
        for word in PARTS.findall(marked):
            ids = known.get(word)
            if ids is None:
                ids = [i for part in stream(word, self.vocab) for i in part]
                if len(word) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of ids: blanks are spaces, the one put before the first word goes, bytes that are not UTF-8 are replaced."""
    text = b"".join([vocab.bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, ids array<int>`` for each row; narrow. Null and empty texts have no ids. Extra columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = [np.array(encoder.encode(x.as_py() or ""), dtype=np.int32) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id>, text`` for each row; narrow. Null ids give an empty text."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode(x.as_py() or [], vocab) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def coded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_ids, ids_crc32, n_chars, round_trip`` for each row: whether decoding its ids gives the text again.

    A text with the blank character itself comes back with spaces, so its round trip is false.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                ids = encoder.encode(text)
                rows.append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(text), decode(ids, vocab) == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_ids", "ids_crc32", "n_chars", "round_trip"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, n_chars long, round_trip boolean").withColumnRenamed("id", id_col)
