"""Candidates as a stream: first sightings, windowed counts, and a union kept up to date pass by pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from siftstone.operators import union
from siftstone.sources import checkpoint


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen(candidates: DataFrame, delay: str = "7 days", by_file: bool = False) -> DataFrame:
    """Candidates whose key wasn't seen within the delay, by event time ``ts``; state of older keys is dropped."""
    keyed = candidates.withColumn("key", union.candidate_key(by_file))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def counts(candidates: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window, severity, n) of event-time windows; rows later than the delay are left out."""
    late = candidates.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", size), "severity").agg(F.count("*").alias("n"))


#: Batches between two foldings of all that a stream keeps.
EVERY = 20


def keep_union(candidates: DataFrame, path: str, by_file: bool = False, every: int = EVERY) -> DataStreamWriter:
    """A writer that keeps the union of all candidates so far below ``path``: a batch writes its own rows, folded, and nothing else.

    Every ``every`` batches the rows since the last such batch, and what it held, are folded into one base, and what
    lies before that base is removed (the base before it stays, so a batch that is run again finds what it read the
    first time, and overwrites its own). So bytes written grow with the batches, not with their square. Severity votes
    are counted with the rows, which the median weighs.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"key": union.candidate_key(by_file), "n_votes": F.lit(1)})
        checkpoint.save(_folded(rows), f"{path}/rows/{n}")
        if n and n % every == 0:
            checkpoint.save(_folded(_rows(spark, path, n, n - every if n > every else None, every)), f"{path}/base/{n}")
            for old in range(max(0, n - 3 * every), n - 2 * every + 1):
                checkpoint.remove(spark, f"{path}/rows/{old}")
            if n > 2 * every:
                checkpoint.remove(spark, f"{path}/base/{n - 2 * every}")

    return candidates.writeStream.foreachBatch(merge)


def _folded(rows: DataFrame) -> DataFrame:
    """A row that repeats another but for seq and time adds its vote only."""
    same = [c for c in rows.columns if c not in ("seq", "ts", "n_votes")]
    return rows.groupBy(*same).agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"), F.sum("n_votes").cast("int").alias("n_votes"))


def _rows(spark: SparkSession, path: str, n: int, base: int | None, every: int) -> DataFrame:
    """The rows of batches up to n: those of a base, if there is one, and those of each batch after it."""
    first = 0 if base is None else base + 1
    parts = [] if base is None else [checkpoint.load(spark, f"{path}/base/{base}")]
    parts += [checkpoint.load(spark, f"{path}/rows/{i}") for i in range(first, n + 1)]
    return reduce(DataFrame.unionByName, parts)


def kept_union(spark: SparkSession, path: str, n: int, every: int = EVERY) -> DataFrame:
    """The union after batch n, its severities weighed by all votes. every: as it was written."""
    rows = _folded(_rows(spark, path, n, n // every * every or None, every))
    return union.fold(rows, key=F.col("key"), votes=F.col("n_votes"))
