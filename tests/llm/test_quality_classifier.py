from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tableweave.llm import quality_classifier as C

SF = "/root/testdata/sf0.1"


def made(n: int, seed: int = 1):
    r = random.Random(seed)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 6)))
    return [(k, " ".join(word("abcdefgh" if k % 2 else "mnopqrst") for _ in range(30)), k % 2) for k in range(n)]


def test_learns_from_the_folds_that_are_not_held_out(spark):
    rows = made(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, _, _ in rows}
    told = lambda flip: spark.createDataFrame([(k, 1 - q if flip and held[k] else q) for k, _, q in rows], "doc_id long, quality int")
    a = {r.doc_id: r for r in C.classify_quality(docs, told(False)).collect()}
    b = {r.doc_id: r for r in C.classify_quality(docs, told(True)).collect()}
    assert all(a[k].held_out == held[k] and a[k].score == b[k].score for k in a)
    assert np.mean([a[k].predicted == q for k, _, q in rows if held[k]]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in a.values())


def test_degenerate_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "text", 1), (2, "", 1), (3, "a" * 600_000, 1)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.classify_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, None), (2, 1), (None, 0), (9, 0)], "doc_id long, quality int")
    assert C.classify_quality(docs, some).count() == 5 and C.classify_quality(docs.limit(0), some).count() == 0


def test_features_of_parts_are_those_of_the_whole(monkeypatch):
    text = made(2)[0][1] + " a a a b"
    whole = np.sort(C.features(text))
    monkeypatch.setattr(C, "PART_CHARS", 20)
    assert (np.sort(C.features(text)) == whole).all()


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.classify_quality(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    order = score.argsort().argsort() + 1
    n = (y == 1).sum()
    auc = (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    assert auc > 0.8, auc
