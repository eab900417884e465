"""Joins by position: rows that belong together because they stand at the same place in their tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROW = "row_idx"
ERROR = "ERROR"


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = ROW) -> DataFrame:
    """Rows numbered from 0 within the keys, in a declared order."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def number_column(df: DataFrame, keys: list[str], order: list[str | Column], known_first: str, name: str = "no") -> DataFrame:
    """A first column of row numbers from 0, called ``name``: put before a table that begins with the column it is known to
    begin with, whatever its case; else in the place of the column that it begins with."""
    own = [c for c in df.columns if c not in keys]
    rest = own if own and own[0].lower() == known_first.lower() else own[1:]
    return numbered(df, keys, order, "__n").select(*keys, F.col("__n").alias(name), *[F.col(f"`{c}`") for c in rest])


def zipped(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of ``keys, row_idx, ...`` side by side; where one is shorter its columns are null.

    All joins are on the same keys, so each table is shuffled once.
    """
    return reduce(lambda a, b: a.join(b, [*keys, ROW], "full"), tables)


def replicated(df: DataFrame, one_row: DataFrame, keys: list[str]) -> DataFrame:
    """The one row that each table's lookup has, at every row of the table."""
    return df.join(one_row.drop(ROW), keys)


def gathered(matches: DataFrame, lookup: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Lookup rows by ``keys, match array<int>``: one result row for each index. What isn't in the lookup is ERROR.

    The joins are on keys and row number; no lookup is collected.
    """
    each = matches.select(*keys, F.posexplode("match").alias("__new", ROW))
    found = each.join(lookup.select(*keys, ROW, *columns, F.lit(True).alias("__there")), [*keys, ROW], "left")
    own = [F.when(F.col("__there"), F.col(f"`{c}`")).otherwise(F.lit(ERROR)).alias(c) for c in columns]
    return found.select(*keys, F.col("__new").alias(ROW), *own)


def exploded(lists: DataFrame, keys: list[str], columns: list[str], values: str = "values") -> DataFrame:
    """``keys, values array<array<string>>`` as rows of the named columns; rows of another length are null throughout."""
    each = lists.select(*keys, F.posexplode(values).alias(ROW, "__v"))
    right = F.size("__v") == len(columns)
    return each.select(*keys, ROW, *[F.when(right, F.get("__v", F.lit(k))).alias(c) for k, c in enumerate(columns)])


def chunked(df: DataFrame, keys: list[str], order: list[str | Column], rows: int) -> DataFrame:
    """``chunk`` of so many rows each, in order."""
    return numbered(df, keys, order, "__n").withColumn("chunk", F.floor(F.col("__n") / rows).cast("int")).drop("__n")


# ---- vectors of decisions


def repaired_match(match: Column, n: Column) -> Column:
    """Match vectors with 0 for -1; null where an index isn't in the lookup."""
    zero = F.transform(match, lambda x: F.when(x == -1, 0).otherwise(x))
    return F.when(F.forall(zero, lambda x: (x >= 0) & (x < n)), zero)


def known_matches(match: Column, n: Column) -> Column:
    """Without indices beyond the lookup where the vector is longer than it."""
    return F.when(F.size(match) > n, F.filter(match, lambda x: x < n)).otherwise(match)


def chosen(choices: DataFrame, tables: DataFrame, keys: list[str], number: str = "table_id") -> DataFrame:
    """The tables that ``keys, indices`` choose; an index that no table has is an error."""
    sizes = tables.groupBy(*keys).agg(F.max(number).alias("__last"))
    each = choices.select(*keys, F.explode("indices").alias(number)).join(sizes, keys, "left")
    fine = (F.col(number) >= 0) & (F.col(number) <= F.coalesce("__last", F.lit(-1)))
    checked = each.withColumn(number, F.when(fine, F.col(number)).otherwise(F.raise_error(F.concat(F.lit("no table "), F.col(number).cast("string"))).cast("int")))
    return tables.join(checked.select(*keys, number).distinct(), [*keys, number], "left_semi")


def unanswered(tables: DataFrame, keys: list[str], column: str, number: str = "table_id") -> DataFrame:
    """The sub-tables to ask about: the first of each document with its type column; the others take that one's answer."""
    rest = [c for c in tables.columns if c not in (*keys, column)]
    first = tables.groupBy(*keys, column).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(number)).alias("__first"))
    return first.select(*keys, column, "__first.*").select(*[F.col(f"`{c}`") for c in tables.columns])


def reused(tables: DataFrame, answers: DataFrame, keys: list[str], column: str) -> DataFrame:
    """All sub-tables with the answer to their type column (``keys, column, ...``, one each); null where there is none."""
    return tables.join(answers, [*keys, column], "left")


def fitted(values: Column, n: Column, pad: str = "N/A") -> Column:
    """A vector cut or padded to n."""
    some = F.slice(values, F.lit(1), F.least(F.size(values), n))
    return F.concat(some, F.array_repeat(F.lit(pad), F.greatest(n - F.size(values), F.lit(0))))


def spread(values: Column, n: Column) -> Column:
    """A vector of one repeated answer as that answer for all n rows; others stay."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.array_repeat(F.get(values, F.lit(0)), n)).otherwise(values)


def collapsed_times(times: Column, units: Column) -> tuple[Column, Column]:
    """Many times with one unit as one comma-separated time and its unit; null where units differ."""
    one = F.size(F.array_distinct(units)) == 1
    return F.when(one, F.array_join(times, ", ")), F.when(one, F.get(units, F.lit(0)))


def header_categories_fault(categories: Column, n_columns: Column, needed: str, exactly_one: bool = True) -> Column:
    """What is wrong with a map of headers to categories: its size, or how often the needed category occurs; null if nothing."""
    n = F.size(F.filter(F.map_values(categories), lambda c: c == needed))
    wrong = (n != 1) if exactly_one else (n < 1)
    return F.when(F.size(categories) != n_columns, "column count").when(wrong, F.lit(f"{needed} count"))


def key_mismatches(refined: DataFrame, original: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, mismatches``: rows whose key column isn't the original one at their place, quotes aside."""
    plain = lambda c: F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    a = refined.select(*keys, ROW, plain(F.col(f"`{column}`")).alias("__a"))
    b = original.select(*keys, ROW, plain(F.col(f"`{column}`")).alias("__b"))
    return a.join(b, [*keys, ROW], "full").groupBy(*keys).agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("mismatches"))


def patched(df: DataFrame, patches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Corrections ``keys, row_idx, column, new_value`` applied: the declarative form of repairing a table."""
    by_row = patches.groupBy(*keys, ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", "new_value"))).alias("__p"))
    found = df.join(by_row, [*keys, ROW], "left")
    return found.withColumns({c: F.coalesce(F.element_at("__p", F.lit(c)), F.col(f"`{c}`")) for c in columns}).drop("__p")
