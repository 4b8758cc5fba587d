"""Comparison of two results, by issue and by axis, and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"language": "languages", "framework": "frameworks", "protocol": "protocols"}


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, flip) of results (id, outcome): newly_found, newly_missed, newly_false_positive or fixed_false_positive. One full join."""
    kinds = {"found": ("newly_found", "newly_missed"), "false_positive": ("newly_false_positive", "fixed_false_positive")}
    of = lambda df, name: df.where(F.col("outcome").isin(*kinds)).select("id", "outcome", F.lit(True).alias(name)).distinct()
    rows = of(before, "b").join(of(after, "a"), ["id", "outcome"], "full").where("a is null or b is null")
    flip = F.when(F.col("outcome") == "found", F.when(F.col("a"), "newly_found").otherwise("newly_missed")).otherwise(F.when(F.col("a"), "newly_false_positive").otherwise("fixed_false_positive"))
    return rows.select("id", flip.alias("flip"))


def catch_rate_moves(before: DataFrame, after: DataFrame, flipped: DataFrame) -> DataFrame:
    """(id, rate_before, rate_after) of (id, found, runs) where the rate to three decimals changed and nothing flipped."""
    rate = lambda df, name: df.select("id", (F.col("found") / F.col("runs")).alias(name))
    rows = rate(before, "b").join(rate(after, "a"), "id", "full")
    rounded = [F.bround(F.coalesce(c, F.lit(0.0)), 3).alias(n) for c, n in (("b", "rate_before"), ("a", "rate_after"))]
    found = flipped.where(F.col("flip").isin("newly_found", "newly_missed")).select("id")
    return rows.select("id", *rounded).where("rate_before <> rate_after").join(found, "id", "left_anti")


def axis_values(refs: Column, tags: Column, axis: str) -> Column:
    """The labels that an issue has on an axis, from its knowledge refs (``vuln:x``, ``guide:languages/x``) and tags."""
    if axis == "tag":
        return F.array_distinct(tags)
    name = lambda r: F.substring_index(r, ":", -1)
    if axis == "vulnerability":
        return F.array_distinct(F.transform(F.filter(refs, lambda r: r.startswith("vuln:")), name))
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis}; there are tag, vulnerability, {', '.join(AXES)}")
    own = F.filter(refs, lambda r: r.startswith("guide:") & (F.substring_index(name(r), "/", 1) == AXES[axis]))
    return F.array_distinct(F.transform(own, lambda r: F.substring_index(r, "/", -1)))


def flips_by_axis(flipped: DataFrame, attribution: DataFrame, axis: str) -> DataFrame:
    """(flip, label, id): each flip under its labels, ``unattributed`` without any. attribution: (id, refs, tags)."""
    rows = flipped.join(attribution, "id", "left")
    none = F.array().cast("array<string>")
    labels = axis_values(F.coalesce("refs", none), F.coalesce("tags", none), axis)
    return rows.select("flip", F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unattributed")))).alias("label"), "id")


def regression_gate(before: DataFrame | None, after: DataFrame, errors: Column, precision: Column, floor: float, unresolved: DataFrame | None = None) -> DataFrame:
    """(rule, detail) of each failure. before and after: (id, outcome); errors and precision: of after, as literals or columns of ``after``'s summary."""
    spark = after.sparkSession
    one = spark.range(1)
    fails = [one.where(errors > 0).select(F.lit("errors").alias("rule"), errors.cast("string").alias("detail"))]
    if floor:
        fails.append(one.where(precision < floor).select(F.lit("precision below floor").alias("rule"), precision.cast("string").alias("detail")))
    base = after.limit(0) if before is None else before
    moved = flips(base, after)
    fails.append(moved.where("flip = 'newly_false_positive'").select(F.lit("new false positive").alias("rule"), F.col("id").cast("string").alias("detail")))
    if before is not None:
        fails.append(moved.where("flip = 'newly_missed'").select(F.lit("newly missed").alias("rule"), F.col("id").cast("string").alias("detail")))
    if unresolved is not None:
        fails.append(unresolved.select(F.lit("unresolved reference").alias("rule"), F.col("ref").alias("detail")))
    out = fails[0]
    for f in fails[1:]:
        out = out.unionByName(f)
    return out
