"""Loose comparisons of cells: abbreviations, numbers in texts, vectors, and the equalities that scoring uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableweave.functions.scalars import all_numbers, first_number, is_plain_number

THRESHOLD = 0.42
EPSILON = 1e-6
Similarity = Callable[[Column, Column], Column]


def is_abbreviation(a: Column, b: Column) -> Column:
    """Whether the letters of the shorter text are found, in order, in the longer one, whatever the case.

    Of texts of one length the second counts as the shorter. Two empty texts are alike; one empty text, or a shorter text
    without letters, isn't like anything. A fold over the longer text's characters counts the letters found so far, so that
    time and memory grow with its length alone; the letters are an array that is made once.
    """
    def told(p: Column) -> Column:
        x, y = p["x"], p["y"]
        second = F.char_length(x) >= F.char_length(y)
        empty = (F.char_length(x) == 0).cast("int") + (F.char_length(y) == 0).cast("int")
        return F.struct(F.when(second, y).otherwise(x).alias("short"), F.when(second, x).otherwise(y).alias("long"), empty.alias("empty"))

    def letters_of(p: Column) -> Column:
        return F.struct(p["long"].alias("long"), p["empty"].alias("empty"), F.split(F.regexp_replace(p["short"], "[^a-z]", ""), "").alias("letters"))

    def alike(p: Column) -> Column:
        letters, long = p["letters"], p["long"]
        found = F.aggregate(F.split(long, ""), F.lit(0), lambda n, c: F.when(F.get(letters, n) == c, n + 1).otherwise(n))
        # most texts lack the first or the last letter, so that nothing need be counted
        there = F.contains(long, letters[0]) & F.contains(long, F.element_at(letters, -1))
        some = F.when((letters[0] == "") | ~there, F.lit(False)).otherwise(found == F.size(letters))
        return F.when(p["empty"] == 2, F.lit(True)).when(p["empty"] == 1, F.lit(False)).otherwise(some)

    # steps over the only element of an array, so that nothing is computed anew at each mention
    pair = F.array(F.struct(F.lower(F.trim(a)).alias("x"), F.lower(F.trim(b)).alias("y")))
    return F.coalesce(F.get(F.transform(F.transform(F.transform(pair, told), letters_of), alike), F.lit(0)), F.lit(False))


def same_numbers(a: Column, b: Column) -> Column:
    """Whether both texts hold the same numbers in the same order (or none)."""
    return all_numbers(a).eqNullSafe(all_numbers(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def exact_similarity(a: Column, b: Column) -> Column:
    """Stands in where no embeddings are at hand: 1 for equal texts, whatever their case, else 0."""
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).otherwise(0.0)


def text_similarity(a: Column, b: Column, similarity: Similarity = exact_similarity) -> Column:
    """1 for abbreviations, 0 for texts with different numbers, else what the given similarity says."""
    if similarity is exact_similarity:  # equal texts have equal numbers
        return F.when(is_abbreviation(a, b), 1.0).otherwise(similarity(a, b))
    return F.when(is_abbreviation(a, b), 1.0).when(~same_numbers(a, b), 0.0).otherwise(similarity(a, b))


def loosely_equal(a: Column, b: Column, similarity: Similarity = exact_similarity) -> Column:
    """Equality for finding the row that another one stands for. Null is a missing number.

    Plain numbers are compared as such; a text against a number by the first number in it; two texts by similarity. A
    missing number equals another and every text that isn't a number.
    """
    da, db = is_plain_number(a), is_plain_number(b)
    na, nb = F.when(da, a.try_cast("double")), F.when(db, b.try_cast("double"))
    text, number = F.when(da | a.isNull(), b).otherwise(a), F.when(da | a.isNull(), na).otherwise(nb)
    close = F.coalesce(F.abs(first_number(F.trim(text)) - number) < EPSILON, F.lit(False))
    lone = F.trim(text).try_cast("double").isNull()
    mixed = F.when(number.isNull(), lone).otherwise(close)
    both_numbers = F.when(na.isNull() & nb.isNull(), True).otherwise(F.coalesce(F.abs(na - nb) < EPSILON, F.lit(False)))
    texts = ~da & ~db & a.isNotNull() & b.isNotNull()
    return F.when(a.eqNullSafe(b), True).when(texts, text_similarity(a, b, similarity) >= THRESHOLD).when((da | a.isNull()) & (db | b.isNull()), both_numbers).otherwise(mixed)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")


def equal_text(a: Column, b: Column, similarity: Similarity = exact_similarity) -> Column:
    """Equality of texts for rating; null equals null and the empty text."""
    def told(p: Column) -> Column:
        x, y = p["x"], p["y"]
        alike = F.when(F.lower(x) == F.lower(y), True).otherwise(text_similarity(x, y, similarity) > THRESHOLD)
        return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), F.coalesce(x, y) == "").otherwise(alike)

    # without quotes once, as the only element of an array
    return F.get(F.transform(F.array(F.struct(_unquoted(a).alias("x"), _unquoted(b).alias("y"))), told), F.lit(0))


def equal_number(a: Column, b: Column) -> Column:
    """Equality of the first numbers for rating; two texts without a number are equal."""
    x, y = first_number(_unquoted(a)), first_number(_unquoted(b))
    return F.when(x.isNull() & y.isNull(), True).otherwise(F.coalesce(F.abs(x - y) < EPSILON, F.lit(False)))
