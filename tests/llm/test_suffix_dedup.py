from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from tableweave.llm import suffix_dedup as S


def brute(texts: list[str | None], window: int = 200) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + window] for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        stay = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(stay).hexdigest()))
    return out


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeößé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (40, 60, 45, 300)]
    texts: list[str | None] = [None, "", "x" * 150, "x" * 199, "x" * 200, "x" * 230, "x" * 1000, "ab" * 400]
    for _ in range(40):
        texts.append(" ".join(r.choice([prose(r.randint(1, 60)), r.choice(passages)]) for _ in range(r.randint(1, 5))))
    texts += [texts[10], texts[10], texts[12]]
    for _ in range(12):  # near copies
        t = list(texts[20] or "")
        for _ in range(3):
            t[r.randrange(len(t))] = "z"
        texts.append("".join(t))
    p = prose(70)
    texts += [p[:199], p[:200], p[1:201], "q" + p[:200], p[50:260] + "!" + p[50:249]]
    return texts


def rows(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs).orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert rows(spark, texts) == brute(texts)


def test_hot_buckets_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    filler = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(1, 40)))
    texts = [f"{filler()} {passage} {filler()}" for _ in range(700)]
    assert rows(spark, texts) == brute(texts)


def test_empty_table_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, id int, tag string, list string, n_bytes int"
    assert S.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(None, long, 1, "t", "l", 2), (None, long, 1, "t", "l", 2), (7, long, 0, None, None, None), (7, None, 0, None, None, None)], schema)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect())
    assert got == [("7", 0, 0, 0), ("7", 300, 300, 1), ("None", 300, 300, 1), ("None", 300, 300, 1)]


def test_difference_cover():
    for v in (7, 32, 64):
        c = S.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))
        shifts = S.common_shifts(c, v)
        a, b = np.meshgrid(np.arange(v), np.arange(v), indexing="ij")
        assert np.isin((a + shifts) % v, c).all() and np.isin((b + shifts) % v, c).all()


def test_very_long_rows_are_cut_into_chunks(monkeypatch):
    r = np.random.default_rng(2)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 4000, 5000])
    whole = [np.concatenate(c) for c in zip(*S.anchors_of(data, offsets), strict=True)]
    monkeypatch.setattr(S, "CHUNK", 300)
    parts = [np.concatenate(c) for c in zip(*S.anchors_of(data, offsets), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
