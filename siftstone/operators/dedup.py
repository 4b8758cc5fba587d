"""First-wins deduplication. ``seq`` says which row is first; the rest is one group-by, so hot keys combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import folded

FINDING_KEY = ("file", "line", "category", "description")
PLACE_KEY = ("file", "line", "category")


def first_wins(df: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """The row of the least seq of each key; null keys are equal. The least row is a partial aggregate, so no group is held or sorted."""
    names = df.columns
    rest = [c for c in names if c != seq]
    row = F.struct(F.col(seq), *(F.col(c) for c in rest))
    keyed = df.select(*(k.alias(f"_k{i}") for i, k in enumerate(keys)), F.col(seq).alias("_seq"), row.alias("_row"))
    return keyed.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by("_row", "_seq").alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in names))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding of each (file, line, category, description)."""
    return first_wins(findings, [F.col(c) for c in FINDING_KEY])


def dedup_places(findings: DataFrame) -> DataFrame:
    """One finding of each (file, line, category)."""
    return first_wins(findings, [F.col(c) for c in PLACE_KEY])


def collapse_colocated(candidates: DataFrame) -> DataFrame:
    """One candidate of each (file, line, category), in any case; those without a file or line all stay."""
    placed = (folded(F.col("file")) != "") & F.col("line").isNotNull()
    alone = F.when(~placed, F.col("seq"))  # a key of its own
    return first_wins(candidates, [folded(F.col("file")), F.col("line"), folded(F.col("category")), alone])
