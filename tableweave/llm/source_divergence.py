"""How far the sources of a language lie apart in their words: triangular discrimination over wide term vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableweave.llm.quality_rules import bound
from tableweave.llm.text import lower, slices, utf8
from tableweave.plans.materialize import cut, hinted

#: Bytes of text whose terms are counted at once; a longer text is a slice of its own.
SLICE = 8 << 20
MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
# Terms are runs of ASCII letters and of characters beyond ASCII.
_term = np.zeros(256, dtype=bool)
_term[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) without rounding, as a long; counts beyond 9 * 10^9 take decimals."""
    below = F.greatest(total + 2 * kept, F.lit(1))  # 0 where no term is kept, and nobody asks
    wide = _div((count.cast("decimal(20,0)") + F.lit(2)) * F.lit(UNIT), below.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(count < 9 * UNIT, _div((count + 2) * UNIT, below)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); (p - q)^2 is at most 10^18."""
    return _div((p - q) * (p - q), p + q)


def dense(places: Column, size: Column) -> Column:
    """The array of ``size`` longs that has n at i for each struct (i, n) of ``places``, which ascend by i; else 0."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    parts = F.transform(
        places,
        lambda x, k: F.concat(zeros(x["i"] - F.when(k > 0, F.get(places, k - 1)["i"]).otherwise(F.lit(-1)) - 1), F.array(x["n"])),
    )
    return F.concat(F.flatten(parts), zeros(size - 1 - F.element_at(places, -1)["i"]))


def counted_terms(groups: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """The terms of some texts: group, term, occurrences in the group's texts, and texts of the group that have it.

    ``data`` is the texts' UTF-8 bytes, ``offsets`` (from 0) where each begins. Terms are compared as strings, not by hashes.
    """
    low = lower(data)
    inside = _term[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    kept = np.cumsum(inside, dtype=np.int64)  # bytes of terms up to and with each byte
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(low[inside].tobytes())).dictionary_encode()
    rows, n_terms = np.searchsorted(offsets, starts, side="right") - 1, len(terms.dictionary)
    each, n = np.unique(rows * n_terms + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, term = np.divmod(each, max(n_terms, 1))
    pairs, place, docs = np.unique(groups[row] * n_terms + term, return_inverse=True, return_counts=True)
    group, term = np.divmod(pairs, max(n_terms, 1))
    return group, terms.dictionary.take(pa.array(term)), np.bincount(place, weights=n, minlength=len(pairs)).astype(np.int64), docs


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents that have the term. Null texts and names count as ''.

    Terms are counted within slices of some megabytes of text, then by map-side combined sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            named = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
            groups = [tuple(x.values()) for x in named.to_pylist()]
            known = {x: k for k, x in enumerate(dict.fromkeys(groups))}
            names, codes = list(known), np.array([known[x] for x in groups], dtype=np.int64)
            for a, b in slices(offsets, SLICE):
                group, term, n, found = counted_terms(codes[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(found)], names=["lang", "source", "term", "n", "docs"])

    names = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    each = docs.select(*names, F.col(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The kept terms as vectors over the sources of their language, and the languages.

    Vectors: ``lang, term, total, places`` (structs of source number and count, ascending, none of them 0). Languages, one
    row each: ``lang, kept, total, sources, totals`` (a name and a count of kept terms for each source number).
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col), "audit-counts")
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    names = cut(names.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "audit-sources")
    gathered = counts.join(hinted(names), ["lang", "source"]).groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("i", "n"))).alias("places"),
    )
    vectors = cut(gathered.filter(F.col("docs") >= min_docs).drop("docs"), "audit-vectors")
    sums = vectors.select("lang", F.inline("places")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    whole = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("total"))
    zero = F.lit(0).cast("long")
    listed = (
        names.join(sums, ["lang", "i"], "left")
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "source", F.coalesce("n", zero).alias("n")))).alias("all"))
        .join(whole, "lang", "left")
        .select("lang", F.coalesce("kept", zero).alias("kept"), F.coalesce("total", zero).alias("total"), F.col("all.source").alias("sources"), F.col("all.n").alias("totals"))
    )
    return vectors, cut(listed, "audit-languages")


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each two sources of a language lie apart, and by which terms.

    A language's vocabulary is the terms that at least ``min_docs`` of its documents have. A group's share p of a term is
    ``share``; two shares are ``distance`` apart. Part ``pair`` has for each source every other source of its language and
    the sum over the vocabulary; part ``term`` the ``top_terms`` terms that the source has more often than its language,
    by their distance. Ranks begin at 1 for each source and part, by value and then by the item's bytes.

    1. Terms are counted within slices of the documents, then by map-side combined sums.
    2. Each term becomes one row with its counts as an array over the language's sources (as long as the answer's row of
       that source). A term that neither of two sources has adds the same to every pair, so that is added once, times the
       vocabulary; lambda functions emit a pair's difference from it for the other terms, and partial sums before the
       shuffle leave a row for each task and pair.
    3. Terms of a source are ranked with the limit applied before the shuffle.

    Null texts, languages and sources count as ''; a source without terms still has its pairs, with value 0 where the
    vocabulary is empty. A repeated row is another document. A text is counted in one piece, however long.
    Other columns aren't read. An empty table gives an empty result.
    """
    vectors, languages = term_vectors(docs, min_docs, text_col, lang_col, source_col)
    heads = hinted(languages.select("lang", "kept", F.col("total").alias("whole"), "totals", F.transform("totals", lambda n: share(F.lit(0).cast("long"), n, F.col("kept"))).alias("zs")))
    shares = vectors.join(heads, "lang").select(
        "lang", "term", "places", "zs", share(F.col("total"), F.col("whole"), F.col("kept")).alias("q"),
        bound(dense(F.col("places"), F.size("totals")), lambda ns: F.transform(ns, lambda n, i: share(n, F.get("totals", i), F.col("kept")))).alias("ps"),
    )
    rows = shares.select("lang", "zs", "ps", F.posexplode("ps").alias("i", "p"))

    def emitted(i: Column, p: Column, ps: Column, zs: Column) -> Column:
        others = F.transform(F.slice(ps, i + 2, F.size(ps)), lambda x, k: F.struct((i + 1 + k).alias("j"), x.alias("p"), F.get(zs, i + 1 + k).alias("z")))
        z = F.get(zs, i)
        seen = F.filter(others, lambda x: (p != z) | (x["p"] != x["z"]))
        return F.transform(seen, lambda x: F.struct(x["j"].alias("j"), (distance(p, x["p"]) - distance(z, x["z"])).alias("more")))

    more = rows.select("lang", "i", F.inline(emitted(F.col("i"), F.col("p"), F.col("ps"), F.col("zs")))).groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    more = cut(more, "audit-pairs")
    named = languages.select("lang", "kept", "totals", "sources", F.posexplode("sources").alias("i", "source"))
    zero_of = lambda i: share(F.lit(0).cast("long"), F.get("totals", i), F.col("kept"))
    pairs = named.select("lang", "kept", "totals", "i", "source", F.posexplode("sources").alias("j", "item")).filter("i <> j")
    base = F.when(F.col("kept") > 0, F.col("kept") * distance(zero_of(F.col("i")), zero_of(F.col("j")))).otherwise(F.lit(0).cast("long"))
    both = more.unionByName(more.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "more"))
    pairs = pairs.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("more", F.lit(0).cast("long"))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    own = shares.select("lang", "term", "q", "ps", F.explode("places.i").alias("i")).withColumn("p", F.get("ps", F.col("i"))).filter("p > q")
    own = own.select("lang", "i", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top_terms)
    terms = best.join(named.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
