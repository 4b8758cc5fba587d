"""State between runs as Parquet below a folder: a new version is written whole, then read back strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNION = "key string, seq long, title string, category string, endpoint string, symbol string, file string, line int, severity string, evidence string, status string, source string, found_by array<string>"


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write df where it may have been read from: beside it, whole, then in its place.

    The table moves out and the new one in, by renames, and a reader who finds that a run broke off between them ends it
    (``settle``). So there is a whole table at any time, the old one or the new one.
    """
    spark = df.sparkSession
    settle(spark, path)
    save(df, f"{path}-next")
    _swap(spark, path)


def settle(spark: SparkSession, path: str) -> None:
    """End a replacement that broke off when the new table was whole and the old one moved out."""
    if not _whole(spark, path) and _whole(spark, f"{path}-next"):
        _swap(spark, path)


def _swap(spark: SparkSession, path: str) -> None:
    place, fs = _files(spark, path)
    old, new = _files(spark, f"{path}-old")[0], _files(spark, f"{path}-next")[0]
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(new, place)
    fs.delete(old, True)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A saved table; a missing or corrupt one raises when it is read."""
    settle(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", "FAILFAST").parquet(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records; a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline records; malformed ones are left out."""
    kind = "seq int, stage string, started_at timestamp, seconds double, ok boolean"
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def append_timeline(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


MARKER = ".siftstone-workspace"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str) -> None:
    """Mark a folder as a review's workspace."""
    place, fs = _files(spark, f"{path}/{MARKER}")
    if not fs.exists(place):
        fs.create(place).close()


def has_prior_run(spark: SparkSession, path: str) -> bool:
    """Whether a workspace holds a run's output: a candidate, finding or proof, or a reviewed unit. Units that were seeded only don't count."""
    for name in ("candidates", "findings", "pocs"):
        if exists(spark, f"{path}/{name}") and not load(spark, f"{path}/{name}").isEmpty():
            return True
    return exists(spark, f"{path}/worklist") and not load(spark, f"{path}/worklist").where("status = 'reviewed'").isEmpty()


def clear(spark: SparkSession, path: str) -> list[str]:
    """Remove what a workspace holds; a folder with something in it and without the marker isn't one, and raises ValueError."""
    place, fs = _files(spark, path)
    if not fs.exists(place):
        return []
    children = [c.getPath() for c in fs.listStatus(place)]
    if children and not any(c.getName() == MARKER for c in children):
        raise ValueError(f"{path} is not empty and no workspace")
    for c in children:
        fs.delete(c, True)
    return sorted(c.getName() for c in children if c.getName() != MARKER)


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _files(spark, path)
    fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there whole, in any store that Spark can reach."""
    settle(spark, path)
    return _whole(spark, path)


def _whole(spark: SparkSession, path: str) -> bool:
    place, fs = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(place)
