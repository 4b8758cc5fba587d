"""Numbers and running sums in an order over all rows, without a task that holds all of them.

Rows are dealt into key ranges and sorted there; their place in a range, and what the ranges before hold (a row a range,
as many as there are shuffle partitions), give the number. Ties are broken by a running number, so a key that a third of
all rows have is cut like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed


def in_order(rows: DataFrame, order: Sequence[str], within: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """rows with ``place``, their number from 0 in the order, and ``x_before`` for each x of sums: its sum over earlier rows.

    With ``within``, numbers are those in the groups of equal ``within``. Rows alike in the order are numbered in any order.
    """
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*within, *order]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = checkpointed(tied.repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    group = [F.col(w).alias(f"_of_{w}") for w in within]
    held = placed.groupBy(F.col("_range").alias("_of"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"), *(F.sum(x).alias(f"_sum_{x}") for x in sums))
    # a row for each range, and one more for each group that ends in it
    before = Window.partitionBy(*(f"_of_{w}" for w in within)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_of", *(f"_of_{w}" for w in within), "_first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_b") for c in ("_rows", *(f"_sum_{x}" for x in sums))))
    same = F.col("_range") == F.col("_of")
    for w in within:
        same &= F.col(w).eqNullSafe(F.col(f"_of_{w}"))
    joined = placed.join(starts, same).withColumn("place", F.col("_rows_b") + F.col("_at") - F.col("_first"))
    if sums:
        inside = Window.partitionBy("_range", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumns({f"{x}_before": F.col(f"_sum_{x}_b") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    return joined.select(*rows.columns, F.col("place").cast("long").alias("place"), *(f"{x}_before" for x in sums))
