from __future__ import annotations

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tableweave.llm import packing as P
from tableweave.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, texts, most):
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = P.pack(docs, PATH, most).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert len(ids) <= most or n == 0 or r.length == most
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(by_sequence), sum(r.length for r in rows)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


def test_documents(spark):
    r = random.Random(1)
    texts = [None, "", "<|endoftext|>", "naïve 中文 \U0001f600"] + [" ".join(r.choice(["alpha", "ß", "of", "1234"]) for _ in range(r.randint(1, 200))) for _ in range(80)]
    n, tokens = check(spark, texts + texts[:10], 100)
    assert n <= tokens / 100 * 1.1 + 1
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_plan_is_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.randint(5, 60)
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = P.plan_bins(counts, capacity)
        used = defaultdict(int)
        for size, _, n, first, each, _ in plan:
            for k in range(n):
                used[first + k // each] += size
        assert sum(x[2] for x in plan) == len(lengths) and all(v <= capacity for v in used.values())
        assert len(used) == best_fit_decreasing(lengths, capacity)


def test_tree_finds_the_tightest_capacity():
    r, tree, have = random.Random(3), P.CapacityTree(40), set()
    for _ in range(500):
        c = r.randint(0, 40)
        have ^= {c}
        tree.set(c, c in have)
        size = r.randint(0, 40)
        assert tree.tightest(size) == min((x for x in have if x >= size), default=-1)


def test_added_tokens_have_their_ids(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "naïve <|endoftext|>1234", "<|endoftext|", "<|ENDOFTEXT|>", "", "퟿  a  "]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0].count(50256) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op8_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in rows.collect()} == {k: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for k, x in enumerate(ids)}
