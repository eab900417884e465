from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tableweave.llm import norm_search as N

SCHEMA = "vec_id long, embedding array<double>, label int, length double, id string, score string"


def brute(rows, k=10, scale=1024, every=100):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]  # noqa: B905
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, every=100, **more):
    df = spark.createDataFrame([(i, v, 0, 1.0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = N.nearest(df, F.col("vec_id") % every == 0, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(r, n, d, spread):
    """Lengths between 1 and ``spread``, with some near-copies, so that every kind of pruning has work."""
    rows, base = [], [[r.gauss(0, 1) for _ in range(d)] for _ in range(8)]
    for k in range(n):
        v = [x + r.gauss(0, 0.05) for x in r.choice(base)] if r.random() < 0.5 else [r.gauss(0, 1) for _ in range(d)]
        size = math.exp(r.uniform(0, math.log(spread))) / math.sqrt(sum(x * x for x in v))
        rows.append((k, [x * size for x in v]))
    return rows


@pytest.mark.parametrize("spread", [1.0001, 50.0])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(N, "BUCKET_COMPONENTS", 12 * 64)
    monkeypatch.setattr(N, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(N, "CELL_BLOCKS", 2)
    rows = vectors(random.Random(7), 900, 12, spread)
    assert found(spark, rows, every=20) == brute(rows, every=20)
    assert found(spark, rows, every=50, k=3, scale=10) == brute(rows, 3, 10, 50)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, []), (300, None), (400, [1.0, None]), (500, [1.0, nan]), (600, [inf, 0.0]), (1, [-1.0, -2.0]), (2, [1.0, 2.0, 3.0]), (3, [1e-9, -1e-9])]
    rows += [(None, [9.0, 9.0]), (-100, [1.0]), (7, [1.0, 2.0]), (5, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == [] == found(spark, [(1, [1.0]), (2, [1.0])]) == found(spark, [])


def test_ties_and_copies_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 0.5]) for k in range(3000)]
    got = found(spark, rows, every=1000)
    assert got == brute(rows, every=1000) and [x[2] for x in got if x[0] == 0] == list(range(1, 11))


def test_repeated_rows_have_their_own_results(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [3.0])]
    assert found(spark, rows) == [(0, 1, 1, 1024 * 3072), (0, 1, 1, 2048 * 3072), (0, 2, 1, 1024 * 3072), (0, 2, 1, 2048 * 3072)]


def test_large_numbers_are_exact_or_cut_off(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0]), (1, [1.0, 3.0]), (2, [1.0 + 2**-10, -5.0]), (3, [big, big])]
    got = found(spark, rows, scale=1)
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 1, 2**40 + 3), (0, 3, 2, 2**40 - 5)]


def test_pruning_by_coordinates_keeps_what_reaches_the_threshold():
    import numpy as np

    r = np.random.default_rng(3)
    rows = np.floor(r.normal(size=(500, 6)) * 100)
    norms = np.sqrt((rows * rows).sum(axis=1))
    bucket = N.Block(np.arange(500).astype("<i8").tobytes(), rows.astype("<f8").tobytes(), norms.astype("<f8").tobytes(), "<f8", 6)
    for _ in range(50):
        q = r.normal(size=6)
        q /= np.sqrt(q @ q)
        cos = rows @ q / norms
        for t in (0.5, 0.8, 0.95):
            kept = set(N.in_focus(bucket, q, t, 3).tolist())
            assert set(np.flatnonzero(cos >= t).tolist()) <= kept and len(kept) < 500
