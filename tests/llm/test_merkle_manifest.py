from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tableweave.llm import merkle_manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])])


def climb(nodes, fanout):
    """Root, and for each node its siblings level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(places):
            first = p // fanout * fanout
            proofs[k].append((nodes[first:p], nodes[p + 1 : first + fanout]))
        nodes = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        places = [p // fanout for p in places]
    return nodes[0], proofs


def brute(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, tops = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        sub, proofs = trees[g]
        for x, proof in zip(sorted(groups[g]), proofs, strict=True):
            out.append((x[3], g, x[2], sub, root, [("".join(a), "".join(b)) for a, b in proof + top]))
    return out


def rows_of(df):
    return [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(x.before, x.after) for x in r.proof]) for r in df.collect()]


def key(x):
    return (str(x[1]), x[0] is not None, x[0] or 0, x[2], str(x[5]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, node string, __index int"


def docs_of(spark, rows):
    cols = ("doc_id", "text", "lang", "source", "n_chars")
    return spark.createDataFrame([(*[r[c] for c in cols], "r", "n", 1) for r in rows], SCHEMA)


def some(n, r, langs):
    return [{"doc_id": k, "text": r.choice([None, "", "Text", "ÄÖ:1", "x" * 5000]), "lang": r.choice(langs), "source": r.choice([None, "s"]), "n_chars": r.choice([None, 0, -3, 10**12])} for k in r.sample(range(-50, 10 * n), n)]


def test_against_brute_force(spark):
    r = random.Random(3)
    for n, langs, fanout, levels in ((1, ["a"], 8, 3), (9, [None], 8, 3), (300, [None, "", "de", "fr", "é"], 8, 1), (300, [str(k) for k in range(20)], 3, 2), (700, ["en"], 8, 3), (130, ["b", "c"], 2, 3)):
        rows = some(n, r, langs)
        df = M.dataset_manifest(docs_of(spark, rows).repartition(3), fanout=fanout, levels=levels)
        assert df.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof"]
        assert sorted(rows_of(df), key=key) == sorted(brute(rows, fanout), key=key)
        roots = df.select(M.folded(F.col("leaf"), F.col("proof")).alias("f"), "root", M.proof_digest(F.col("proof")).alias("d"), "proof").collect()
        assert all(x.f == x.root and x.d == h(*[y.before + y.after for y in x.proof]) for x in roots)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [{"doc_id": i, "text": t, "lang": g, "source": "s", "n_chars": 1} for i, t, g in ((1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (None, None, "x"), (None, "c", None), (2, None, None))]
    got = sorted(rows_of(M.dataset_manifest(docs_of(spark, rows))), key=key)
    assert got == sorted(brute(rows), key=key)
    assert M.dataset_manifest(docs_of(spark, rows).limit(0)).count() == 0


def test_a_changed_field_doesnt_lead_to_the_root(spark):
    rows = [{"doc_id": k, "text": "Text" if k % 2 else "text", "lang": "en", "source": "s", "n_chars": 4} for k in range(40)]
    docs = docs_of(spark, rows)
    fields = [F.lower("text") if c == "text" else F.col(c) for c in M.FIELDS]
    got = M.dataset_manifest(docs, carried={"other": M.leaf_digest(fields)}).select("doc_id", (M.folded(F.col("other"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert {r.doc_id: r.same for r in got} == {k: k % 2 == 0 for k in range(40)}
    # '-' for null isn't the text '-', and lengths keep fields apart
    a, b = ({"doc_id": 1, "text": t, "lang": g, "source": "s", "n_chars": 4} for t, g in ((None, "ab"), ("-", "ab")))
    assert leaf(a) != leaf(b)
