from __future__ import annotations

import re
from collections import Counter, defaultdict

from tableweave.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, rank string, i int, term string"


def brute(rows, min_docs=10, top=10):
    """By the definition, with Python's integers: rows are (text, lang, source)."""
    words = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, g, s in rows]
    out = set()
    for lang in {g for g, _, _ in words}:
        own = [(s, w) for g, s, w in words if g == lang]
        docs = Counter(t for _, w in own for t in set(w))
        kept = [t for t in docs if docs[t] >= min_docs]
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(t for t in w if docs[t] >= min_docs)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(shares[s][t], q[t]), t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def found(df, **more):
    rows = df.collect() if more.pop("collected", False) else S.source_divergence(df, **more).collect()
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    import random

    r = random.Random(5)
    words = ["der", "die", "Straße", "STRASSE", "été", "𝒜b", "x1y", "don't", "a_b", "é", "z", "Ω", "ß", "Zz", "zz"]
    rows = []
    for _ in range(250):
        s = r.choice(["s1", "s2", "s3", "s 4", "ß", None])
        text = r.choice([" ", "\n", "-", "\x00"]).join(r.choices(words, weights=[1 + (len(w) * 7 + len(s or "")) % 5 for w in words], k=r.randint(0, 12)))
        rows.append((text, r.choice(["de", "fr", None]), s))
    rows += [(None, "de", "silent"), ("", "none", "a"), ("word", "none", "b"), ("lone", "one", "only"), ("der " * 5000, "de", "s1"), ("der die", "de", "s1"), ("der die", "de", "s1")]
    docs = spark.createDataFrame([(k, *x, "r", 0, "t") for k, x in enumerate(rows)], SCHEMA).repartition(3)
    assert found(docs) == brute(rows)
    assert found(docs, min_docs=1, top_terms=3) == brute(rows, 1, 3)
    assert found(docs, min_docs=10_000) == brute(rows, 10_000) and any(x[4] == 0 for x in brute(rows, 10_000))
    assert S.source_divergence(docs.limit(0)).count() == 0


def test_counts_beyond_what_a_long_product_holds(spark):
    from pyspark.sql import functions as F

    rows = [(8_999_999_999, 10**13, 10), (9_000_000_000, 10**13, 10), (5 * 10**12, 10**13, 10**6), (0, 0, 1)]
    got = [r.p for r in spark.createDataFrame(rows, "n long, total long, kept long").select(S.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in rows]
