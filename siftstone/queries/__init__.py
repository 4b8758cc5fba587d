"""The engine's queries over the test tables: each operator on a projection of them, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from siftstone.queries import findings, knowledge, paths, records, review, scoring, text

    return {k: v for m in (findings, paths, text, knowledge, scoring, records, review) for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from siftstone.queries import findings, knowledge, paths, records, review, scoring, text

    return {k: v for m in (findings, paths, text, knowledge, scoring, records, review) for k, v in m.SQL.items()}
