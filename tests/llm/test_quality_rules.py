from __future__ import annotations

import random
import re
from collections import Counter

from tableweave.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def corpus():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé#|\U0001f600") for _ in range(r.randint(1, n)))
    texts = [None, "", "\n\n", "a", "a b a b a b", "a a a a", "x\ny\nx\n x\n\n", "tab\tand\x0bvt\x0cff nbsp em", "w " * 5000]
    texts += [" ".join(word(k % 4 + 1) for _ in range(r.randint(1, 200))) for k in range(60)]
    return texts + ["\n".join(r.choice(["one line", "two lines", ""]) for _ in range(30)) for _ in range(5)]


def test_measures_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = Q.quality_verdicts(docs).orderBy("doc_id").collect()
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]
    assert got == [brute(t) for t in texts]


def test_hosts_are_judged_by_shrunken_rates(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(k, "short", "bad") for k in range(95)] + [(100 + k, good(), "bad") for k in range(5)]
    rows += [(1000 + 100 * h + k, good(), f"good{h}") for h in range(6) for k in range(50)] + [(5000, "short", "tiny"), (5001, good(), "tiny"), (6000, good(), None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {x.doc_id: x for x in Q.quality_verdicts(docs).collect()}
    assert len(told) == len(rows)
    assert not told[100].base_failed and not told[100].kept  # a fine document of a host that is mostly bad
    assert told[5001].kept and told[6000].kept and told[6000].host_failure_rate is None and not told[None].kept
    kept = Q.keep_quality(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(k for k, x in told.items() if x.kept)
    shrunk, plain = told[5001].host_failure_rate, 0.5
    assert shrunk != plain


def test_empty_tables_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, source string, __words string, base_failed int, n_words string, host string"
    empty = spark.createDataFrame([], schema)
    assert Q.quality_verdicts(empty).count() == 0 and Q.keep_quality(empty).count() == 0
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "s", "a", 1, "n", "h"), (1, text, "s", "a", 1, "n", "h"), (2, "few", "s", "a", 1, "n", "h")], schema)
    assert sorted(x.doc_id for x in Q.keep_quality(docs).collect()) == [1, 1] and Q.quality_verdicts(docs).count() == 3
