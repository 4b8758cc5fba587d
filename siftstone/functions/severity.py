"""Severity levels: CRITICAL, HIGH, MEDIUM and LOW as text, with ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import strip

#: The levels from the worst, and their SARIF levels.
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SARIF = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
DEFAULT = "MEDIUM"


def _case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda out, pair: F.when(pair[0], pair[1]).otherwise(out), reversed(pairs), default)


def normalize(c: Column) -> Column:
    """The first level that the text contains, in any case; MEDIUM if none."""
    text = F.upper(strip(F.coalesce(c, F.lit(""))))
    return _case([(F.contains(text, F.lit(level)), F.lit(level)) for level in LEVELS], F.lit(DEFAULT))


def exact(c: Column) -> Column:
    """The level that the text is but for its case; MEDIUM if it is none."""
    text = F.upper(F.coalesce(c, F.lit("")))
    return F.when(text.isin(*LEVELS), text).otherwise(DEFAULT)


def index(c: Column, unknown: int = LEVELS.index(DEFAULT)) -> Column:
    """0 for CRITICAL to 3 for LOW."""
    return _case([(c == level, F.lit(i)) for i, level in enumerate(LEVELS)], F.lit(unknown))


def rank(c: Column) -> Column:
    """0 for LOW to 3 for CRITICAL."""
    return F.lit(len(LEVELS) - 1) - index(c)


def by_rank(c: Column) -> Column:
    """The level of a rank; MEDIUM for null."""
    return F.coalesce(F.get(F.array(*map(F.lit, reversed(LEVELS))), c.cast("int")), F.lit(DEFAULT))


def sarif_level(c: Column) -> Column:
    return _case([(c == k, F.lit(v)) for k, v in SARIF.items()], F.lit("warning"))


def upper_median(ranks: Column) -> Column:
    """The upper middle one of collected ranks, as a level; MEDIUM for none."""
    ordered = F.array_sort(ranks)
    return by_rank(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def median_level(level: Column, votes: Column | None = None) -> Column:
    """The upper middle level of a group, an aggregate; a row counts as many votes. Ranks are counted, so its state doesn't grow with the group."""
    one = F.lit(1) if votes is None else votes
    n = F.sum(F.when(level.isNotNull(), one))
    counts = [F.sum(F.when(level.isNotNull() & (rank(level) <= r), one).otherwise(0).cast("long")) for r in range(len(LEVELS))]
    # the value at place n // 2 of the sorted ranks is the first whose cumulative count exceeds it
    return _case([(counts[r] > F.floor(n / 2), F.lit(LEVELS[-1 - r])) for r in range(len(LEVELS))], F.lit(DEFAULT))


def middle(counts: Sequence[int]) -> str:
    """The upper middle level of so many votes for each of LEVELS; MEDIUM for none."""
    upto = 0
    for level, n in zip(reversed(LEVELS), reversed(counts), strict=True):
        upto += n
        if upto > sum(counts) // 2:
            return level
    return DEFAULT
