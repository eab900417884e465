"""Scoring of an extracted table against a baseline: matching of rows by anchors, then rating of columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.functions.similarity import Similarity, cosine, equal_number, equal_text, exact_similarity, loosely_equal
from tableweave.plans.materialize import cut, hinted_by_size

ROW = "row_idx"
#: Rating columns as (name, is a number, weight).
Rated = list[tuple[str, bool, float]]


def harmonized(df: DataFrame, canonical: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns under their canonical names, in order, those that aren't known dropped and those that lack null.

    Names match without regard to case, surrounding blanks and byte-order marks, directly or by an alias. Cells are
    trimmed, without byte-order marks, with middle dots as decimal points.
    """
    known = {c.lower(): c for c in canonical} | {a.lower(): c for a, c in (aliases or {}).items()}
    found: dict[str, str] = {}
    for c in df.columns:
        if (name := known.get(c.replace("﻿", "").strip().lower())) and name not in found:
            found[name] = c
    tidy = lambda c: F.trim(F.translate(F.col(f"`{c}`").cast("string"), "·∙•﻿", "..."))
    return df.select(*[(tidy(found[c]) if c in found else F.lit(None).cast("string")).alias(c) for c in canonical])


def best_anchor_match(row: Column, candidates: Column, anchors: list[str], similarity: Similarity = exact_similarity) -> Column:
    """The place in ``candidates`` (array of structs) of the row that ``row`` (a struct) stands for, -1 if there is none.

    Anchors narrow the candidates one after the other; a blank anchor is passed over, a null one counts as a missing number. One candidate left is the
    answer. When an anchor leaves none, the next one starts again from all. In the end the answer is the first of the last
    anchor's matches. A fold over the anchors, so that only the state is kept: the answer, the matches, the candidates.
    """
    every = F.sequence(F.lit(0), F.size(candidates) - 1)
    none = F.array().cast("array<int>")
    state = F.struct(F.lit(False).alias("done"), none.alias("hits"), every.alias("open"))
    for c in anchors:
        state = F.element_at(F.transform(F.array(state), _narrowing(row[c], c, candidates, every, similarity)), 1)
    return F.coalesce(F.get(state["hits"], F.lit(0)), F.lit(-1))


def _narrowing(own: Column, name: str, candidates: Column, every: Column, similarity: Similarity) -> Callable[[Column], Column]:
    """The step of one anchor, from state to state."""

    def step(s: Column) -> Column:
        # compared once, as the only element of an array: each mention would compare all candidates anew; equal candidates
        # are compared together
        values = F.array_distinct(F.transform(s["open"], lambda k: F.get(candidates, k)[name]))
        alike = F.filter(values, lambda v: loosely_equal(own, v, similarity))
        found = lambda alike: F.filter(s["open"], lambda k: F.exists(alike, lambda v: v.eqNullSafe(F.get(candidates, k)[name])))
        hits = F.element_at(F.transform(F.array(alike), found), 1)
        narrowed = lambda h: F.struct((F.size(h) == 1).alias("done"), h.alias("hits"), F.when(F.size(h) == 0, every).otherwise(h).alias("open"))
        return F.when(s["done"] | F.coalesce(F.trim(own) == "", F.lit(False)), s).otherwise(F.element_at(F.transform(F.array(hits), narrowed), 1))

    return step


def row_score(a: Callable[[str], Column], b: Callable[[str], Column], rated: Rated, similarity: Similarity = exact_similarity) -> Column:
    """The weighted share of equal columns, as a whole number of tenths."""
    points = [F.when(equal_number(a(c), b(c)) if number else equal_text(a(c), b(c), similarity), F.lit(w)).otherwise(0.0) for c, number, w in rated]
    return F.floor(10.0 * reduce(lambda x, y: x + y, points) / sum(w for _, _, w in rated)).cast("int")


def table_score(scores: Column, less: Column, more: Column) -> Column:
    """Summed row scores, of ten for each row of the shorter table and one for each that the longer has more; 0..100."""
    return F.floor(100.0 * scores / (10.0 * less + (more - less))).cast("int")


SIMILARITIES = "__similarities"


def _cell_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")))


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("\u001f", F.least(a, b), F.greatest(a, b))


def looked_up_similarities(baseline: DataFrame, target: DataFrame, keys: list[str], columns: list[str], vectors: DataFrame) -> DataFrame:
    """``keys, __similarities``: for each table the cosines of the texts that may meet in one of its columns.

    ``vectors`` is ``text, vector``, as any model gives them. Only texts that have a vector are paired, as numbers that stand
    for them; the distinct pairs are joined to vectors and rated, once each, however many tables they occur in. A table's
    own pairs aren't written: they are made again from its texts where its similarities are looked up, and stay where the
    table is. Only where ratings are too many to be broadcast they are shuffled. Both tables of a key are small; their number isn't.
    """
    texts = vectors.select(_cell_text(F.col("text")).alias("__text"), "vector").filter("__text <> ''").groupBy("__text").agg(F.min("vector").alias("__vector"))
    known = cut(texts.withColumn("__id", F.monotonically_increasing_id()), "similar-vectors")
    named = hinted_by_size(known.select("__text", "__id"), F.octet_length("__text"))

    def ids(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(k).alias("__column"), _cell_text(F.col(f"`{c}`")).alias("__text")) for k, c in enumerate(columns)])
        told = df.select(*keys, F.inline(cells)).join(named, "__text")
        return told.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("__column") == k, F.col("__id"))).alias(f"{name}{k}") for k in range(len(columns))])

    both = F.array(*[F.struct(F.col(f"__x{k}").alias("__xs"), F.col(f"__y{k}").alias("__ys")) for k in range(len(columns))])
    met = ids(baseline, "__x").join(ids(target, "__y"), keys).select(*keys, F.inline(both))
    met = met.select(*keys, "__ys", F.explode("__xs").alias("__x")).select(*keys, "__x", F.explode("__ys").alias("__y")).filter("__x <> __y")
    met = met.select(*keys, F.least("__x", "__y").alias("__a"), F.greatest("__x", "__y").alias("__b"))
    side = lambda name: hinted_by_size(known.select(F.col("__id").alias(name), F.col("__text").alias(f"t{name}"), F.col("__vector").alias(f"v{name}")), F.octet_length(f"t{name}") + 8 * F.size(f"v{name}"))
    rated = met.select("__a", "__b").distinct().join(side("__a"), "__a").join(side("__b"), "__b")
    rated = rated.select("__a", "__b", _pair(F.col("t__a"), F.col("t__b")).alias("__pair"), cosine(F.col("v__a"), F.col("v__b")).alias("__s")).filter("__s IS NOT NULL")
    rated = cut(rated, "similar-rated")
    told = met.join(hinted_by_size(rated, F.octet_length("__pair") + 24), ["__a", "__b"])
    # a pair that meets twice, in two columns or either way round, has one rating
    return told.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("__pair", "__s"))).alias(SIMILARITIES))


def by_lookup(a: Column, b: Column) -> Column:
    """The similarity of ``looked_up_similarities``; 1 for one text, and 0 for texts that weren't rated."""
    x, y = _cell_text(a), _cell_text(b)
    return F.when(x == y, 1.0).otherwise(F.coalesce(F.try_element_at(F.col(SIMILARITIES), _pair(x, y)), F.lit(0.0)))


def score_tables_by_vectors(baseline: DataFrame, target: DataFrame, keys: list[str], anchors: list[str], rated: Rated, vectors: DataFrame) -> DataFrame:
    """``score_tables`` with texts compared by their vectors, which are joined, not computed in an expression."""
    columns = list(dict.fromkeys([*anchors, *[c for c, number, _ in rated if not number]]))
    similar = looked_up_similarities(baseline, target, keys, columns, vectors)
    return score_tables(baseline, target, keys, anchors, rated, by_lookup, similar)


def _counterparts(
    baseline: DataFrame, target: DataFrame, keys: list[str], anchors: list[str], rated: Rated, similarity: Similarity, similar: DataFrame | None = None
) -> DataFrame:
    """``keys, less_rows, more_rows, pairs`` of every baseline: each row of the shorter table and its counterpart, or null."""
    columns = list(dict.fromkeys([*anchors, *[c for c, _, _ in rated]]))
    pack = lambda df: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(ROW, *columns))).alias("__rows"))
    packed = pack(baseline).withColumnRenamed("__rows", "__b")
    both = packed.join(pack(target).withColumnRenamed("__rows", "__t"), keys, "left")
    t = F.coalesce("__t", F.array().cast(packed.schema["__b"].dataType))
    short = F.size("__b") <= F.size(t)
    carried = [] if similar is None else [SIMILARITIES]
    both = both if similar is None else both.join(similar, keys, "left")
    sides = both.select(*keys, *carried, F.when(short, F.col("__b")).otherwise(t).alias("less"), F.when(short, t).otherwise(F.col("__b")).alias("more"))
    mate = lambda row: F.get("more", best_anchor_match(row, F.col("more"), anchors, similarity))
    return sides.select(*keys, *carried, F.size("less").alias("less_rows"), F.size("more").alias("more_rows"), F.transform("less", lambda row: F.struct(row.alias("row"), mate(row).alias("mate"))).alias("pairs"))


def _summed(points: Callable[[Column, Column], Column], zero: Column) -> Column:
    return F.aggregate("pairs", zero, lambda s, p: s + F.when(p["mate"].isNull(), zero).otherwise(points(p["row"], p["mate"])))


def score_tables(
    baseline: DataFrame, target: DataFrame, keys: list[str], anchors: list[str], rated: Rated, similarity: Similarity = exact_similarity, similar: DataFrame | None = None
) -> DataFrame:
    """``keys, less_rows, more_rows, score`` of every baseline table.

    Both sides have the keys, ``row_idx`` and the columns. The shorter table's rows (the baseline's when they tie) look for
    their counterparts in the longer one, whose rows may serve several times; a row without one scores 0. A table without
    target rows scores 0, and so do all where the sides differ in their number of columns. A table's rows are packed into
    arrays, since matching narrows down whole sets of candidates; tables are small, their number isn't. ``similar`` is what
    a similarity looks things up in, by table.
    """
    told = _counterparts(baseline, target, keys, anchors, rated, similarity, similar)
    points = _summed(lambda a, b: row_score(lambda c: a[c], lambda c: b[c], rated, similarity), F.lit(0))
    score = table_score(points, F.col("less_rows"), F.col("more_rows")) if len(baseline.columns) == len(target.columns) else F.lit(0)
    return told.select(*keys, "less_rows", "more_rows", score.alias("score"))


def score_tables_separately(baseline: DataFrame, target: DataFrame, keys: list[str], anchors: list[str], rated: Rated, similarity: Similarity = exact_similarity) -> DataFrame:
    """As ``score_tables``, but ``text_score, number_score``: shares of equal columns of either kind, unweighted, unrounded by row."""
    told = _counterparts(baseline, target, keys, anchors, rated, similarity)

    def share(p: Column, number: bool) -> Column:
        names = [c for c, n, _ in rated if n == number]
        equal = lambda c: equal_number(p["row"][c], p["mate"][c]) if number else equal_text(p["row"][c], p["mate"][c], similarity)
        return 10.0 * reduce(lambda x, y: x + y, [F.when(equal(c), 1.0).otherwise(0.0) for c in names]) / len(names) if names else F.lit(0.0)

    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("n"))
    # one fold over the pairs for both scores, so that the matching isn't repeated
    points = F.aggregate("pairs", zero, lambda s, p: F.when(p["mate"].isNull(), s).otherwise(F.struct((s["t"] + share(p, False)).alias("t"), (s["n"] + share(p, True)).alias("n"))))
    same = len(baseline.columns) == len(target.columns)
    score = lambda part, number: table_score(F.col(f"points.{part}"), F.col("less_rows"), F.col("more_rows")) if same and any(n == number for _, n, _ in rated) else F.lit(0)
    told = told.select(*keys, "less_rows", "more_rows", points.alias("points"))
    return told.select(*keys, "less_rows", "more_rows", score("t", False).alias("text_score"), score("n", True).alias("number_score"))


def score_by_position(baseline: DataFrame, target: DataFrame, keys: list[str], rated: Rated, similarity: Similarity = exact_similarity) -> DataFrame:
    """As ``score_tables`` for tables whose rows correspond by ``row_idx``, with shares of equal text and number columns.

    Nothing is packed: a join on keys and row, then partial sums.
    """
    names = [c for c, _, _ in rated]
    a = baseline.select(*keys, ROW, *[F.col(f"`{c}`").alias(f"a_{c}") for c in names], F.lit(1).alias("in_a"))
    b = target.select(*keys, ROW, *[F.col(f"`{c}`").alias(f"b_{c}") for c in names], F.lit(1).alias("in_b"))
    both = a.join(b, [*keys, ROW], "full")
    mine, theirs = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    paired = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    share = lambda number: [(equal_number if number else equal_text)(mine(c), theirs(c)).cast("int") for c, n, _ in rated if n == number]
    counts = {f"{k}_equal": F.sum(F.when(paired, reduce(lambda x, y: x + y, share(n), F.lit(0))).otherwise(0)) for k, n in (("text", False), ("number", True))}
    told = both.groupBy(*keys).agg(
        F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"), F.sum(F.when(paired, row_score(mine, theirs, rated, similarity)).otherwise(0)).alias("s"),
        *[v.alias(k) for k, v in counts.items()],
    )
    less, more = F.least("rows_a", "rows_b"), F.greatest("rows_a", "rows_b")
    return told.filter("rows_a > 0 AND rows_b > 0").select(*keys, less.alias("less_rows"), more.alias("more_rows"), "text_equal", "number_equal", table_score(F.col("s"), less, more).alias("score"))


def unmatched_targets(targets: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without a baseline, for the report; they aren't scored."""
    return targets.join(baselines.select(*keys).distinct(), keys, "left_anti")
