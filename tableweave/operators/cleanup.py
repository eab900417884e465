"""Cleanup of assembled parameter rows. All cells are texts; a missing one is the text ``N/A``, which equals itself."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tableweave.plans.inputs import dealt_out

MISSING, ERROR = "N/A", "ERROR"
ROW = "row_idx"
# Cells that say a value is missing, spellings of one statistic, units that are no clock times, parameters without a time.
SAME_AS_MISSING = ["n/a", "unknown", "Unknown", "nan"]
SPELLINGS = {"Standard Deviation (SD)": "SD", "s.d.": "SD", "S.D.": "SD", ",": " "}
LONG_UNITS = ["Weeks", "weeks", "Week", "week", "Wks", "wks", "Wk", "wk", "W", "w", "Months", "months", "Month", "month", "Years", "years", "Year", "year"]
TIMELESS = ["Cmax", "Tmax", "Cavg"]
RANGE_PART = r"-?[0-9]+\.[0-9]+"


@dataclass(frozen=True)
class Names:
    """Which columns play which part."""

    value: str = "main_value"
    statistic: str = "statistics_type"
    variation_value: str = "variation_value"
    variation_type: str = "variation_type"
    interval: str = "interval_type"
    lower: str = "lower_bound"
    upper: str = "upper_bound"
    subjects: str = "subject_n"
    identity: list[str] = field(default_factory=list)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def rewritten(df: DataFrame, rules: list[tuple[Column, dict[str, str | Column]]]) -> DataFrame:
    """Rules (condition, new values), one after the other: each sees what those before it did. A null condition is false."""
    for condition, values in rules:
        df = df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(_c(c)) for c, v in values.items()})
    return df


def without_errors(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.array_contains(F.array(*[_c(c) for c in columns]), ERROR), F.lit(False)))


def value_rules(n: Names) -> list[tuple[Column, dict[str, str]]]:
    """Values that only repeat an interval go; statistics, intervals and variations without a value are missing.

    A row with both bounds is a Range, whatever was said. An empty bound is contained in every value, and not missing:
    these rules come before ``normalized``.
    """
    value, stat, lower, upper = _c(n.value), _c(n.statistic), _c(n.lower), _c(n.upper)
    both = (lower != MISSING) & (upper != MISSING)
    said = ~lower.rlike(r"^\s*N/A\s*$") & ~upper.rlike(r"^\s*N/A\s*$")
    return [
        (((stat == _c(n.interval)) | (stat == MISSING)) & ((value == lower) | (value == upper)), {n.value: MISSING, n.statistic: MISSING}),
        (value.contains(lower) & value.contains(upper) & said, {n.value: MISSING}),
        (value == MISSING, {n.statistic: MISSING}),
        ((lower == MISSING) & (upper == MISSING), {n.interval: MISSING}),
        (both, {n.interval: "Range"}),
        (_c(n.variation_value) == MISSING, {n.variation_type: MISSING}),
    ]


def normalized(df: DataFrame, columns: list[str], spellings: dict[str, str] | None = None) -> DataFrame:
    """Whole cells: blank ones and words for missing become N/A, spellings their common form."""
    spellings = SPELLINGS if spellings is None else spellings

    def one(c: Column) -> Column:
        # what is blank sorts before any text; only such cells are matched
        told = F.when(((c < "!") & c.rlike(r"^\s*$")) | c.isin(*SAME_AS_MISSING), MISSING)
        return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), spellings.items(), told).otherwise(c)

    # one expression for all cells, as code for each of many columns is too long to be compiled; a generator, so that no
    # filter behind it holds the expression again
    rest = [_c(c) for c in df.columns if c not in columns]
    told = df.select(*rest, F.explode(F.array(F.transform(F.array(*[_c(c) for c in columns]), one))).alias("__cells"))
    at = {c: k for k, c in enumerate(columns)}
    return told.select(*[F.get("__cells", F.lit(at[c])).alias(c) if c in at else _c(c) for c in df.columns])


def with_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a digit in one of the columns."""
    return df.filter(F.concat_ws("|", *[_c(c) for c in columns]).rlike(r"\p{Nd}"))


def first_of_equal(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows equal in all the columns the first in row order stays. A map-side combined minimum: equal rows don't meet in one task."""
    rest = [c for c in df.columns if c not in (*keys, *columns, ROW)]
    first = F.min(ROW).alias(ROW) if not rest else F.min_by(F.struct(ROW, *[_c(c) for c in rest]), ROW).alias("__first")
    told = df.groupBy(*keys, *[_c(c) for c in columns]).agg(first)
    return told.select(*[F.col(f"__first.`{c}`").alias(c) if rest and c in (ROW, *rest) else _c(c) for c in df.columns])


def split_ranges(df: DataFrame, n: Names) -> DataFrame:
    """A bound that holds two decimals as both bounds, if the other one is missing or says the same. Without decimal points
    nothing is split."""
    lower, upper = _c(n.lower), _c(n.upper)
    found = lambda c: F.regexp_extract_all(c, F.lit(RANGE_PART), F.lit(0))
    # two decimals are seven characters at least
    two = lambda c: (F.char_length(c) >= 7) & (F.size(found(c)) == 2)
    parts = F.when((upper == MISSING) & two(lower), found(lower)).when(((lower == MISSING) | (lower == upper)) & two(upper), found(upper))
    told = df.withColumn("__f", parts)
    return rewritten(told, [(F.col("__f").isNotNull(), {n.lower: F.get("__f", F.lit(0)), n.upper: F.get("__f", F.lit(1))})]).drop("__f")


def without_contained(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Without rows that another row of the same table says as well: equal in every cell, or N/A where they differ.

    Of equal rows the last stays. Rows say which of their cells are missing by a mask, and a table has few different masks:
    each row is put under every mask of its table that has all it misses itself, without the cells that the mask has. A row
    then only looks at those with the same cells under its own mask: at whether any of them says more, and at the last one
    that says the same. All is equality, so no two rows of a table are compared; cells are compared by 128 bits of hashes.
    Null cells are like no other. All groups are within a table, so rows that are dealt out by tables aren't shuffled.
    """
    mask = reduce(lambda a, b: a + b, [F.when(_c(c) == MISSING, F.lit(1 << k)).otherwise(0).cast("long") for k, c in enumerate(columns)])
    some = lambda under, k, c: F.when(under.bitwiseAND(1 << k) != 0, "").otherwise(F.coalesce(_c(c), F.concat(F.lit("\0"), F.col(ROW).cast("string"))))
    # two hashes of 64 bits stand for the cells that a mask leaves
    left = lambda under: [F.xxhash64(F.lit(n), *[some(under, k, c) for k, c in enumerate(columns)]).alias(f"__left{n}") for n in (0, 1)]
    own = [c for c in df.columns if c not in keys]
    told = df.select(*keys, F.struct(*[_c(c) for c in own]).alias("__row"), mask.alias("__own"), *[_c(c) for c in columns if c not in keys], ROW)
    told = told.withColumn("__masks", F.collect_set("__own").over(W.partitionBy(*keys)))
    under = F.filter("__masks", lambda m: F.col("__own").bitwiseAND(F.bitwise_not(m)) == 0)
    each = told.withColumn("__mask", F.explode(under)).withColumn("__same", F.col("__own") == F.col("__mask"))
    # under the masks of others a row needn't be whole
    each = each.select(*keys, "__mask", *left(F.col("__mask")), "__same", ROW, F.when(F.col("__same"), F.col("__row")).alias("__row"))
    group = W.partitionBy(*keys, "__mask", "__left0", "__left1")
    found = each.withColumns({"__more": F.bool_or(~F.col("__same")).over(group), "__last": F.max(F.when(F.col("__same"), F.col(ROW))).over(group)})
    stay = found.filter(F.col("__same") & ~F.col("__more") & (F.col("__last") == F.col(ROW)))
    return stay.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def merged_pairs(df: DataFrame, keys: list[str], identity: list[str], columns: list[str]) -> DataFrame:
    """Pairs of rows of one identity that complete each other, as one row: greedily in order, each row at most once.

    Two rows fit when no column has two different values; what one of them misses the other gives. A pair stands at its
    first row's place, with that row's other columns; ``merged_in_order`` also orders by groups. A fold over
    the rows of a group (of a table and its identity columns): each row completes the first open one that it fits. Taking
    rows in order and open ones in order gives the pairs that looking ahead from each row in turn gives.
    """
    rest = [c for c in df.columns if c not in (*columns, ROW, *keys)]
    told = _paired(df, keys, identity, columns)
    return told.select(*keys, *[_c(c) for c in (ROW, *columns, *rest)])


def merged_in_order(df: DataFrame, keys: list[str], identity: list[str], columns: list[str]) -> DataFrame:
    """``merged_pairs`` in the order of the groups: by the identity's cells, missing ones last, within a group merged rows
    first, then by place. Rows are numbered anew by it, so that what follows (the first of equal rows stays) goes by it."""
    told = _paired(df, keys, identity, columns)
    order = [x for c in identity for x in (_c(c) == MISSING, _c(c))]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order, "__open", ROW)) - 1
    return told.withColumn(ROW, place.cast(df.schema[ROW].dataType)).select(*[_c(c) for c in df.columns])


def _paired(df: DataFrame, keys: list[str], identity: list[str], columns: list[str]) -> DataFrame:
    """The rows of ``merged_pairs``, with ``__open``: whether a row was left alone."""
    rest = [c for c in df.columns if c not in (*columns, ROW, *keys)]
    own = [ROW, *columns, *rest]
    item = F.struct(*[_c(c) for c in own], F.lit(True).alias("__open"))
    packed = df.groupBy(*keys, *[_c(c).alias(f"__id{k}") for k, c in enumerate(identity)]).agg(F.collect_list(item).alias("__rows"), F.count(F.lit(1)).alias("__n"))

    def fits(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) | (a[c] == MISSING) | (b[c] == MISSING) for c in columns], a["__open"])

    def joined(a: Column, b: Column) -> Column:
        cells = [F.when(a[c] == MISSING, b[c]).otherwise(a[c]).alias(c) for c in columns]
        return F.struct(a[ROW].alias(ROW), *cells, *[a[c].alias(c) for c in rest], F.lit(False).alias("__open"))

    def step(state: Column, row: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(state, lambda a: F.coalesce(fits(a, row), F.lit(False))), F.lit(True)), F.lit(0))
        # the place is computed once, as the only element of an array
        put = lambda at: F.when(at == 0, F.concat(state, F.array(row))).otherwise(F.transform(state, lambda a, k: F.when(k + 1 == at, joined(a, row)).otherwise(a)))
        return F.element_at(F.transform(F.array(at), put), 1)

    by_place = F.array_sort("__rows", lambda a, b: F.when(a[ROW] < b[ROW], -1).when(a[ROW] > b[ROW], 1).otherwise(0))
    kind = packed.schema["__rows"].dataType
    paired = F.when(F.col("__n") == 1, F.col("__rows")).otherwise(F.aggregate(by_place, F.array().cast(kind), step))
    return packed.select(*keys, F.explode(paired).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in (*own, "__open")])


def range_to_median(df: DataFrame, keys: list[str], n: Names, identity: list[str]) -> DataFrame:
    """In groups of exactly two rows of which one is a median and the other has a range: the range moves to the median,
    whatever bounds that had, and is missing in the other."""
    group = W.partitionBy(*keys, *[_c(c) for c in identity])
    ranged = (_c(n.statistic) != "Median") & (_c(n.interval) == "Range")
    told = df.withColumns(
        {
            "__fits": (F.count(F.lit(1)).over(group) == 2) & (F.count_if(_c(n.statistic) == "Median").over(group) == 1) & (F.count_if(ranged).over(group) == 1),
            "__l": F.max(F.when(ranged, _c(n.lower))).over(group),
            "__u": F.max(F.when(ranged, _c(n.upper))).over(group),
        }
    )
    median = _c(n.statistic) == "Median"
    moved = lambda c, own: F.when(F.col("__fits"), F.when(median, own).otherwise(MISSING)).otherwise(_c(c))
    told = told.withColumns({n.interval: moved(n.interval, F.lit("Range")), n.lower: moved(n.lower, F.col("__l")), n.upper: moved(n.upper, F.col("__u"))})
    return told.select(*[_c(c) for c in df.columns])


def clean_summary(df: DataFrame, keys: list[str], n: Names, columns: list[str]) -> DataFrame:
    """The cleanup of summary rows. With ``n.identity``, rows that complete each other are merged, tables come in the order of
    their identities (``merged_in_order``) and ranges move to medians.

    Order matters: errors out, value rules, normalization, rows with numbers, pairs merged, equal rows, rows whose value
    repeats the subject count, ranges split, contained rows out, ranges to medians.
    """
    told = rewritten(without_errors(df, columns), value_rules(n))
    told = with_numbers(normalized(told, columns), [n.value, n.variation_type, n.lower, n.upper])
    # all that follows looks at the rows of one table, so they are shuffled once
    told = dealt_out(told, keys)
    if n.identity:
        told = merged_in_order(told, keys, n.identity, columns)
    told = first_of_equal(told, keys, columns).filter(_c(n.subjects) != _c(n.value))
    told = without_contained(split_ranges(told, n), keys, columns)
    return range_to_median(told, keys, n, n.identity) if n.identity else told


def individual_rules(time_value: str, time_unit: str, value: str, kind: str, unit: str) -> list[tuple[Column, dict[str, str]]]:
    """Rules for values of single patients; the last one looks at the value, not at its type, for parameters without a time."""
    return [
        (_c(time_unit).isin(*LONG_UNITS), {time_value: MISSING}),
        (_c(time_value) == MISSING, {time_unit: MISSING}),
        (_c(time_unit) == MISSING, {time_value: MISSING}),
        (_c(value) == MISSING, {kind: MISSING, unit: MISSING}),
        (_c(kind).isin(*TIMELESS), {time_value: MISSING}),
        (_c(value).isin(*TIMELESS), {time_unit: MISSING}),
    ]


def clean_individual(df: DataFrame, keys: list[str], columns: list[str], time_value: str, time_unit: str, value: str, kind: str, unit: str) -> DataFrame:
    """The cleanup of single patients' rows: errors out, rules, normalization, rows with a value, equal rows."""
    told = normalized(rewritten(without_errors(df, columns), individual_rules(time_value, time_unit, value, kind, unit)), columns, {",": " "})
    return first_of_equal(told.filter(_c(value) != MISSING), keys, columns)


def by_first_appearance(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Each table's rows numbered anew: those of the value of ``column`` that appears first, then of the next, in their order."""
    first = df.groupBy(*keys, _c(column).alias("__v")).agg(F.min(ROW).alias("__first"))
    firsts = first.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], "__v", "__first")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)], _c(column).eqNullSafe(F.col("__v")))
    told = df.join(firsts, on)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__first", ROW)) - 1
    return told.withColumn(ROW, place.cast(df.schema[ROW].dataType)).select(*[_c(c) for c in df.columns])


def _integer(cell: Column) -> Column:
    """A whole number, signed or not, with spaces around it; null for any other cell."""
    return F.when(cell.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.regexp_replace(cell, r"[\s_]", "").try_cast("long"))


def _counted(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``df`` with ``__v``, the row's number, ``__all``, whether each row of its table has one, and ``__total``, their sum."""
    told = df.withColumn("__v", _integer(_c(number)))
    tables = told.groupBy(*keys).agg(F.bool_and(F.col("__v").isNotNull()).alias("__all"), F.sum("__v").alias("__total"))
    return told.join(tables, keys)


def without_sum_row(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Without each table's first row whose number is the sum of all others (0 is none), and numbers in their plain form.

    All or nothing by table: where a single cell isn't a whole number, the table stays as it is. Sums and first places are
    map-side combined, so a table's rows needn't meet.
    """
    told = _counted(df, keys, number)
    sums = told.filter("__all AND 2 * __v = __total AND __v <> 0").groupBy(*keys).agg(F.min(ROW).alias(ROW))
    plain = F.when(F.col("__all"), F.col("__v").cast("string")).otherwise(_c(number))
    return told.join(sums, [*keys, ROW], "left_anti").withColumn(number, plain).select(*[_c(c) for c in df.columns])


def largest_of_equal(df: DataFrame, keys: list[str], columns: list[str], number: str) -> DataFrame:
    """Of rows equal in ``columns`` the one with the largest number, of those the first; tables with a cell that isn't a
    whole number stay as they are."""
    told = _counted(df, keys, number)
    row = F.struct(*[_c(c) for c in df.columns])
    best = told.filter("__all").groupBy(*keys, *[_c(c).alias(f"__k{k}") for k, c in enumerate(columns)]).agg(F.min_by(row, F.struct(-F.col("__v"), F.col(ROW))).alias("__best"))
    return best.select("__best.*").unionByName(told.filter("NOT __all").select(*[_c(c) for c in df.columns]))


def clean_specimen(df: DataFrame, keys: list[str], columns: list[str], number: str = "Sample N", by_place: bool = True) -> DataFrame:
    """The cleanup of specimen rows: the row that sums up the others goes; of equal rows the largest number stays.

    The curated pipelines compare rows with their places, so that no two are equal and none goes by the second rule: that
    is ``by_place``. Without it, rows equal in all columns but the number are one.
    """
    told = without_sum_row(df, keys, number)
    return told if by_place else largest_of_equal(told, keys, [c for c in columns if c != number], number)


def renamed(df: DataFrame, names: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Final names, and the final order of columns."""
    told = df.withColumnsRenamed(names)
    return told.select(*[_c(c) for c in order]) if order else told


def closest_name(name: str, known: list[str], cutoff: float = 0.6) -> str | None:
    """The known name itself, else the most alike one by matching blocks, null below the cutoff."""
    return name if name in known else next(iter(difflib.get_close_matches(name, known, n=1, cutoff=cutoff)), None)


def fuzzily_renamed(df: DataFrame, expected: list[str], cutoff: float = 0.8) -> DataFrame:
    """Columns under the expected names they are most alike to; those without one keep theirs. Schemas alone are looked at."""
    return df.toDF(*[closest_name(c, expected, cutoff) or c for c in df.columns])


def resolved_names(df: DataFrame, column: str, known: list[str], cutoff: float = 0.6) -> DataFrame:
    """``column`` with each distinct value replaced by the known name it is closest to, null where there is none.

    The comparison has no SQL form; it runs once for each distinct value of the column.
    """

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(__name=[closest_name(v, known, cutoff) if v is not None else None for v in x["__value"]])

    names = df.select(_c(column).alias("__value")).distinct().mapInPandas(resolve, "__value string, __name string")
    told = df.join(names, _c(column).eqNullSafe(F.col("__value")), "left")
    return told.select(*[F.col("__name").alias(c) if c == column else _c(c) for c in df.columns])
