from __future__ import annotations

import random
import re

import numpy as np

from tableweave.llm import near_dedup as N


def brute(texts: list[str | None]) -> list[tuple[int, int]]:
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def prose(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghiü") for _ in range(r.randint(1, 8))) for _ in range(n)]


def edited(r: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = "".join(r.choice("xyz") for _ in range(4))
    return out


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    texts: list[str | None] = [None, "", "  \n", "one", "ONE", "one two three four", "a b c d e", "A B c d e"]
    for _ in range(15):
        base = prose(r, r.randint(30, 300))
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(edited(r, base, r.randint(0, 6))))
    chain = prose(r, 200)
    for _ in range(12):  # each is linked with its neighbours in the chain alone
        texts.append(" ".join(chain))
        chain = chain[12:] + prose(r, 12)
    passage = prose(r, 60)
    texts += [" ".join(prose(r, r.randint(5, 60)) + passage + prose(r, r.randint(5, 60))) for _ in range(60)]
    r.shuffle(texts)
    return texts


def found(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [(r.n_shingles, r.component_id) for r in N.near_duplicates(docs).orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    texts = corpus(1)
    assert found(spark, texts) == brute(texts)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 8)
    r = random.Random(4)
    base = prose(r, 120)
    texts = [" ".join(edited(r, base, r.randint(1, 9))) for _ in range(60)] + [" ".join(prose(r, 90)) for _ in range(5)]
    assert found(spark, texts) == brute(texts)


def test_degenerate_tables(spark):
    schema = "doc_id long, text string, key int, node string, label int, n int"
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(prose(random.Random(2), 50))
    rows = [(None, text, 1, "x", 1, 1), (None, text, 1, "x", 1, 1), (5, text.upper().replace("Ü", "ü"), 1, "x", 1, 1), (5, text.upper().replace("Ü", "ü"), 1, "x", 1, 1), (9, None, 0, "", 0, 0), (None, "other words entirely", 0, "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in N.near_duplicates(docs).collect())
    assert got == [("5", 46, "5", True), ("5", 46, "5", True), ("9", 0, "9", True), ("None", 1, "None", True), ("None", 46, "5", False), ("None", 46, "5", False)]
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.n) for x in kept.collect()) == [("5", 1), ("9", 0), ("None", 0)]


def test_estimates_are_close():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.2, 0.75, 0.9):
        common = int(2000 * 2 * share / (1 + share))
        a, b = np.unique(x[:2000]), np.unique(x[2000 - common : 4000 - common][:2000])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = N.registers([a, b]).astype(int)
        got = N.estimate(*(np.array([(f(regs[0], regs[1])).sum()]) for f in (np.greater, np.less, np.equal)), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.13


def test_registers_of_a_union_are_the_larger_ones():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 70))
    x = N.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(x[0], x[1]) == x[2]).all()
