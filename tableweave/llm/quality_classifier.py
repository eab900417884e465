"""A supervised text classifier on averaged embeddings of hashed words and character n-grams, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableweave.llm.text import BASE, U, mix, powers, room

BUCKETS_LOG2 = 16
NGRAMS = (2, 3, 4)
#: Characters of text that features are taken from at once; a document's sums run over all of its parts.
PART_CHARS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``max_rows``: the bound on labelled rows that are learned from, those of the least hash of their id."""

    max_rows: int = 8_000
    dim: int = 8
    epochs: int = 8
    rate: float = 0.5
    seed: int = 7


def features(text: str) -> np.ndarray:
    """Buckets of a text's words, of words that repeat the one before, and of the n-grams inside words, all of the text.

    Characters are code points; a blank stands before and after each word. An empty text has the bucket of no word.
    """
    out = list(feature_parts(text))
    return np.concatenate(out) if out else np.zeros(1, dtype=np.int64)


def feature_parts(text: str) -> Iterator[np.ndarray]:
    last, start = None, 0
    while start < len(text):
        end = start + PART_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        found, last = _part(text[start:end], last)
        if len(found):
            yield found
        start = end


def _part(text: str, last: np.uint64 | None) -> tuple[np.ndarray, np.uint64 | None]:
    x = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = (x == 32) | ((x >= 9) & (x <= 13))
    x = np.where(space, 32, x).astype(U)
    h = np.zeros(len(x) + 1, dtype=U)
    up, down = powers(room(len(x)))
    np.cumsum(mix(x + U(1)) * up[: len(x)], out=h[1:])
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    whole = mix((h[ends] - h[starts]) * down[starts], 1)
    before = np.concatenate([np.array([last if last is not None else 0], dtype=U), whole[:-1]]) if len(whole) else whole
    parts = [whole, np.full(int((whole == before).sum()), mix(np.array([BASE]), 99)[0], dtype=U)]
    inner = np.concatenate([[0], np.cumsum(space)])
    for n in NGRAMS:
        at = np.arange(len(x) - n + 1)
        # a window may begin or end with a blank, but has none inside, and isn't blanks alone
        fine = (inner[at + n - 1] - inner[at + 1] == 0) & ~(space[at] & space[at + n - 1] & (n == 2))
        at = at[fine]
        parts.append(mix((h[at + n] - h[at]) * down[at], 2 + n))
    return (np.concatenate(parts) >> U(64 - BUCKETS_LOG2)).astype(np.int64), whole[-1] if len(whole) else last


def counted_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and how often each occurs: at most 2 ** BUCKETS_LOG2, however long the text."""
    return np.unique(features(text), return_counts=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights ``w`` with logit = mean of ``w[features]`` + ``w[-1]``: embeddings and softmax layer, multiplied out.

    The mean of embeddings meets a linear layer, so a bucket matters by one number alone once training is over.
    """
    random = np.random.default_rng(settings.seed)
    n = 1 << BUCKETS_LOG2
    vectors = random.uniform(-1 / settings.dim, 1 / settings.dim, (n, settings.dim)).astype(np.float32)
    layer, bias = np.zeros((settings.dim, 2), np.float32), np.zeros(2, np.float32)
    docs = [(u, (c / c.sum()).astype(np.float32)) for u, c in docs]
    steps, done = max(1, settings.epochs * len(docs)), 0
    for _ in range(settings.epochs):
        for k in random.permutation(len(docs)):
            rate = settings.rate * (1 - done / steps)
            done += 1
            ids, share = docs[k]
            own = vectors[ids]
            hidden = share @ own
            score = hidden @ layer + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            # a bucket's step is scaled up by the number of buckets, as its share of the mean scales it down
            vectors[ids] = own - rate * np.outer(share * min(len(ids), 64), back)
    toward = layer[:, 1] - layer[:, 0]
    return np.append((vectors @ toward).astype(np.float32), np.float32(bias[1] - bias[0]))


def score_text(text: str, weights: np.ndarray) -> float:
    total, n = 0.0, 0
    for part in feature_parts(text):
        total += float(weights[part].sum(dtype=np.float64))
        n += len(part)
    logit = (total / n if n else float(weights[0])) + float(weights[-1])
    return float(1 / (1 + np.exp(-logit)))


def fit(rows: DataFrame, text_col: str, label_col: str, id_col: str, settings: Settings) -> np.ndarray:
    """Learns from at most ``settings.max_rows`` labelled rows (null labels out; null text is empty) in one task.

    Texts become counts of features where they are read, so that what the task gets is bounded by the number of rows,
    whatever their length. Without rows, or with one label alone, every score is that label's share (a half if there is none).
    """
    bounded = (
        rows.filter(F.col(label_col).isin(0, 1))
        .select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit(settings.seed)).alias("at"))
        .orderBy("at", "label", F.xxhash64("text")).limit(settings.max_rows)
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [counted_features(x.as_py()) for x in batch.column(0)]
            cells = [pa.array([x[k].astype("<i4").tobytes() for x in told], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cells], names=["label", "at", "order", "ids", "counts"])

    def learn(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["at", "label", "order"])
        docs = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<i4")) for a, b in zip(x["ids"], x["counts"], strict=True)]
        return pd.DataFrame({"weights": [train(docs, x["label"].to_numpy(), settings).tobytes()]})

    told = bounded.select("text", "label", "at", F.xxhash64("text").alias("order")).mapInArrow(counted, "label int, at long, order long, ids binary, counts binary")
    found = told.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BUCKETS_LOG2) + 1, np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, score``: the probability of label 1 for each row's whole text. Narrow; the weights are 256 KB, broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = [score_text(x.as_py() or "", w) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify_quality(
    docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.3, folds: int = 5
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels of documents whose crc32(doc_id as text) is divisible by ``folds`` are held out of training. Labels, language,
    source and id are never inputs of a score. A document labelled twice is learned twice. Null doc_ids are scored, not
    learned from; they aren't held out. Null and empty texts have no features and score by the bias alone; very long ones
    are read in parts, and learned from by their counts of features. An empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    known = labels.select("doc_id", F.col("quality").alias("__label")).filter(~held & F.col("doc_id").isNotNull() & F.col("__label").isin(0, 1))
    # the sample is chosen on ids before texts are joined: only its texts move
    settings = settings or Settings()
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id", "__label").limit(settings.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    weights = fit(rows, "text", "__label", "doc_id", settings)
    scored = score_documents(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
