"""A running number over rows in order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.plans.stored import stored


def numbered(df: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "n") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... in ``order`` within each group ``by`` (all rows, if none).

    The rows are sorted over ranges of (by, order) and written once with their places; a range's number then begins after
    what earlier ranges hold of the group. So a group of any size is spread over many tasks, and only counts, one row for
    each group and range, meet. Rows equal in ``order`` are numbered in any one order, which the written table fixes; nulls
    in ``by`` are a group.
    """
    by = by or []
    at = stored(df.orderBy(*by, *order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__range", F.shiftright("__at", 33))
    counts = at.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("__k")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a.__range") == F.col("b.__range")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    n = F.col("a.__at") - F.col("b.__first") + F.col("b.__before") + 1
    return at.alias("a").join(starts.alias("b"), on).select(*(F.col(f"a.`{c}`") for c in df.columns), n.alias(name))


def running_sum(df: DataFrame, value: str, order: list[Column | str], by: list[str], name: str = "total") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (a whole number) over the rows before each in ``order`` within its group ``by``.

    As ``numbered``: sums run within the sorted ranges, and only the ranges' totals meet.
    """
    at = stored(df.orderBy(*by, *order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    up_to = Window.unboundedPreceding, -1
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "__range").orderBy("__at").rowsBetween(*up_to)), F.lit(0))
    totals = at.groupBy(*by, "__range").agg(F.sum(value).alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(*up_to)), F.lit(0))).drop("__k")
    on = F.col("a.__range") == F.col("b.__range")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return at.withColumn("__within", within).alias("a").join(totals.alias("b"), on).select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("a.__within") + F.col("b.__before")).alias(name))
