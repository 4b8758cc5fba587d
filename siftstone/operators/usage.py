"""Token, time and stage totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def token_totals(calls: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Calls and their tokens, in all or by group; a missing count is 0."""
    return calls.groupBy(*(group or [])).agg(F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS))


def slowest_units(steps: DataFrame, k: int = 5) -> DataFrame:
    """The k units of most seconds (each step rounded to a tenth), of equal ones the first seen; with their steps."""
    totals = steps.groupBy("unit").agg(F.bround(F.sum(F.bround("seconds", 1)), 1).alias("seconds"), F.count("*").alias("steps"), F.min("seq").alias("seq"))
    return totals.orderBy(F.desc("seconds"), "seq").limit(k)


def timeline_total(timeline: DataFrame) -> DataFrame:
    """One row: stages, seconds and failed stages of a timeline."""
    return timeline.agg(F.count("*").alias("stages"), F.bround(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds"), F.count_if(~F.col("ok")).alias("failed"))
