"""Running sums in the order of a group, by key ranges: no task holds a group, however large it is.

Rows are dealt into ranges of (group, order) by sampled bounds and written, narrow, with their range. What each range has
of each group is a partial sum, a row for each range and one more for each group that ends in it; running over these
gives the sum before every range. Only the range in which a group's sum crosses a bound is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.session import checkpointed

#: Ranges at least.
RANGES = 32


def ranged(rows: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """rows, written, with ``_range``: the number of their key range. Rows alike in the keys may lie in two that follow one another."""
    parts = max(ranges, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return checkpointed(tied.repartitionByRange(parts, *keys, "_tie").drop("_tie").withColumn("_range", F.spark_partition_id()))


def same(names: Sequence[str], prefix: str) -> Column:
    """Whether columns and those of their names with a prefix are alike, nulls too."""
    out = F.lit(True)
    for name in names:
        out &= F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return out


def last_within(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, total: int, ranges: int = RANGES) -> DataFrame:
    """For each group whose sizes reach the total: its columns as ``_of_...``, and ``_last``, the greatest (order, size) before which the sum is below the total.

    Rows count in the order of their columns, then of their sizes; rows alike in both are one place, which the first of
    them decides.
    """
    of = [F.col(g).alias(f"_of_{g}") for g in group]
    placed = ranged(rows.select(*group, *order, F.col(size).cast("long").alias("_size")), [*group, *order, "_size"], ranges)
    held = placed.groupBy(F.col("_range").alias("_in"), *of).agg(F.sum("_size").alias("_sum"))
    whole = Window.partitionBy(*(f"_of_{g}" for g in group)).orderBy("_in")
    before = F.coalesce(F.sum("_sum").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossed = held.withColumn("_before", before).where((F.col("_before") < total) & (F.col("_before") + F.col("_sum") >= total))
    # one range for each group
    there = placed.join(crossed, (F.col("_range") == F.col("_in")) & same(group, "_of_"))
    inside = Window.partitionBy("_range", *group).orderBy(*order, "_size").rowsBetween(Window.unboundedPreceding, -1)
    kept = there.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).where(F.col("_upto") < total)
    return kept.groupBy(*(f"_of_{g}" for g in group)).agg(F.max(F.struct(*order, "_size")).alias("_last"))


def within_total(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, total: int, ranges: int = RANGES) -> DataFrame:
    """rows in order until their sizes reach the total; the one that crosses it stays. What is wide in rows is read where it lies."""
    if total <= 0:
        return rows.limit(0)
    lasts = last_within(rows, group, order, size, total, ranges)
    place = F.struct(*(F.col(c) for c in order), F.col(size).cast("long").alias("_size"))
    return rows.join(lasts, same(group, "_of_"), "left").where(F.col("_last").isNull() | (place <= F.col("_last"))).select(*rows.columns)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, ranges: int = RANGES) -> DataFrame:
    """rows, written, with their number from 0 in their group's order; rows alike in the order are numbered in any order."""
    of = [F.col(g).alias(f"_of_{g}") for g in group]
    placed = ranged(rows, [*group, *order], ranges)
    held = placed.groupBy(F.col("_range").alias("_in"), *of).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*(f"_of_{g}" for g in group)).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("_before", F.coalesce(F.sum("_rows").over(whole), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    return placed.join(starts, (F.col("_range") == F.col("_in")) & same(group, "_of_")).select(*rows.columns, (F.col("_before") + inside).alias(name))
