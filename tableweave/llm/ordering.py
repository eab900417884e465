"""Places in a global order, without a task that sees the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableweave.plans.materialize import cut, hinted


def indexed(df: DataFrame, order: list[Column], group: str | None = None, label: str = "indexed") -> DataFrame:
    """``df`` with ``__index``, its row's place from 0 in ``order`` within ``group``, and ``__count``, the group's rows.

    ``df`` should be a table that has been cut: its ranges are sampled before they are dealt out. The rows are dealt by
    ranges of (group, order), sorted within, and written with their places in their files' tasks; what is counted and
    summed up afterwards is one row for each task and group that meet. A group that has a third of all rows lies in a
    third of the tasks. Rows that are equal in group and order stand side by side in any order. Group values aren't null.
    """
    keys = [F.col(group)] if group else []
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(placed.withColumn("__place", F.monotonically_increasing_id()), label)
    # the upper 31 bits name the task, the lower 33 the row within it
    own = [F.col(group).alias("__of") if group else F.lit("").alias("__of"), F.shiftright("__place", 33).alias("__task")]
    runs = placed.select(*own, F.col("__place").bitwiseAND((1 << 33) - 1).alias("__row")).groupBy("__of", "__task").agg(F.min("__row").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select("__of", "__task", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"), F.sum("__n").over(Window.partitionBy("__of")).alias("__count"))
    joined = placed.select("*", *own).join(hinted(cut(shifts, f"{label}-runs")), ["__of", "__task"])
    return joined.select(*df.columns, (F.col("__place").bitwiseAND((1 << 33) - 1) + F.col("__shift")).alias("__index"), "__count")
