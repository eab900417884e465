"""Reshaping: sub-tables, wide to long, and matrices to records with the headers around a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tableweave.operators.cells import COL, HEADER, ROW, VALUE

MISSING = "N/A"


def sub_tables(df: DataFrame, common: list[str], values: list[str], name: str = "parameter", value: str = "value") -> DataFrame:
    """One sub-table for each value column, with the common columns: ``sub_table`` is the value column's place."""
    order = F.array(*[F.lit(c) for c in values])
    long = df.unpivot(common, values, name, value)
    return long.withColumn("sub_table", (F.array_position(order, F.col(name)) - 1).cast("int"))


def numbered_groups(df: DataFrame, common: list[str], groups: list[dict[str, str]]) -> DataFrame:
    """Numbered columns, as ``{result column: source column}`` for each number, as rows; those whose first is null are left out."""
    names = list(groups[0])
    each = [F.struct(F.lit(k + 1).alias("group_no"), *[F.col(f"`{g[n]}`").cast("string").alias(n) for n in names]) for k, g in enumerate(groups)]
    return df.select(*common, F.inline(F.array(*each))).filter(F.col(f"`{names[0]}`").isNotNull())


def numeric_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with a digit, numbered row by row: ``keys, n, value``."""
    found = cells.filter(F.col(VALUE).rlike("[0-9]"))
    return found.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy(ROW, COL)) - 1).cast("int").alias("n"), VALUE)


def matrix_records(cells: DataFrame, keys: list[str], col_kind: Column, row_kinds: DataFrame | Column) -> DataFrame:
    """Data cells of a table with row headers, subheaders and P values as records.

    ``col_kind`` gives a column's category from its header; ``row_kinds`` (``keys, header, value, kind``, or a column of the
    cells) those of row headers. A cell's row header is in the nearest row-header column to its left, its subheader the
    nearest one above in that column, its P value in the nearest such column to the right. Each is a window, so no cell looks
    at another's row more than once; cells that are dealt out by their tables aren't shuffled for them. Records without a
    digit in the value are left out.
    """
    told = cells.withColumn("__kind", col_kind)
    head = F.coalesce(F.col("__kind") == "Row headers", F.lit(False))
    if isinstance(row_kinds, DataFrame):
        kinds = row_kinds.select(*keys, HEADER, F.col(VALUE).alias("__of"), F.col("kind").alias("__row_kind"))
        told = told.withColumn("__of", F.when(head, F.col(VALUE))).join(kinds, [*keys, HEADER, "__of"], "left").drop("__of")
    else:
        told = told.withColumn("__row_kind", F.when(head, row_kinds))
    above = W.partitionBy(*keys, COL).orderBy(ROW).rowsBetween(W.unboundedPreceding, -1)
    told = told.withColumn("__sub", F.last(F.when(F.col("__row_kind") == "Subheader", F.col(VALUE)), ignorenulls=True).over(above))
    label = F.when(F.col("__sub").isNotNull(), F.concat(F.col("__sub"), F.lit("; "), F.col(VALUE))).otherwise(F.col(VALUE))
    told = told.withColumn("__head", F.when(head, F.struct(label.alias("label"), F.col("__row_kind").alias("kind"))))
    across = W.partitionBy(*keys, ROW).orderBy(COL)
    wide = told.withColumns(
        {
            "__left": F.last("__head", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)),
            "__p": F.first(F.when(F.col("__kind") == "P value", F.col(VALUE)), ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)),
        }
    )
    row_kind, row_label = F.col("__left.kind"), F.col("__left.label")
    data = wide.filter(~F.coalesce(F.col("__kind"), F.lit("")).isin("Row headers", "P value", "Subheader")).filter(~F.coalesce(row_kind == "Subheader", F.lit(False)))

    def cell(kind: str) -> Column:
        by_row, by_col = F.coalesce(row_kind == kind, F.lit(False)), F.coalesce(F.col("__kind") == kind, F.lit(False))
        return F.when(by_row & by_col, F.concat_ws("; ", row_label, F.col(HEADER))).when(by_col, F.col(HEADER)).when(by_row, row_label).otherwise(MISSING)

    records = data.select(*keys, ROW, COL, *[cell(k).alias(k.lower()) for k in ("Characteristic", "Exposure", "Outcome")], F.col(VALUE).alias("value"), F.col("__p").alias("p_value"))
    return records.filter(F.col("value").rlike("[0-9]"))


def aligned_parameters(cells: DataFrame, keys: list[str], decisions: DataFrame, name: str = "Parameter type") -> DataFrame:
    """The parameter column by ``keys, column string``: that column is renamed; null says the headers are the parameters,
    so the table is transposed and its first column named."""
    from tableweave.operators.cells import transpose_and_repair

    turned = transpose_and_repair(cells.join(decisions.filter("`column` IS NULL"), keys, "left_semi"), keys)
    turned = turned.withColumn(HEADER, F.when(F.col(COL) == 0, name).otherwise(F.col(HEADER)))
    named = cells.join(decisions.filter("`column` IS NOT NULL"), keys)
    named = named.withColumn(HEADER, F.when(F.col(HEADER) == F.col("column"), name).otherwise(F.col(HEADER)))
    return named.select(*turned.columns).unionByName(turned)


def aligned_individual(cells: DataFrame, keys: list[str], decisions: DataFrame) -> DataFrame:
    """The same for single patients' tables, where the condition is the opposite one: a named column says that the table is
    to be transposed (headers stay as they come out), null leaves it as it is."""
    from tableweave.operators.cells import transpose_and_repair

    turned = transpose_and_repair(cells.join(decisions.filter("`column` IS NOT NULL"), keys, "left_semi"), keys)
    plain = cells.join(decisions.filter("`column` IS NULL"), keys, "left_semi")
    return plain.select(*turned.columns).unionByName(turned)


def replaced_column(df: DataFrame, keys: list[str], column: str, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """One column replaced, at its place, by the columns that were parsed from it (``keys, row_idx, ...``)."""
    at = df.columns.index(column)
    names = [*df.columns[:at], *columns, *df.columns[at + 1 :]]
    return df.drop(column).join(parsed.select(*keys, ROW, *columns), [*keys, ROW], "left").select(*names)
