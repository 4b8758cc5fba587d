"""What the training-data operators share: table reads, snapshots and text expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from siftstone.session import checkpointed, shared_folder

__all__ = ["WORD", "checkpointed", "col", "discard", "n_words", "noted", "part", "place", "shared_folder", "snapshot", "table", "unit_hash", "utf8", "with_fields"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_places: ContextVar[list[str] | None] = ContextVar("places", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that ``place`` names inside, for a caller who knows when nothing reads them any more."""
    token = _places.set([])
    try:
        yield _places.get()
    finally:
        _places.reset(token)


def place(spark: SparkSession, name: str = "rows") -> str:
    """A new folder in the shared one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (names := _places.get()) is not None:
        names.append(path)
    return path


def snapshot(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to a shared folder as Parquet and read again: columns can be read apart, and made ids hold."""
    path = path or place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a snapshot that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def col(name: str) -> Column:
    """A column by its name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def n_words(text: Column) -> Column:
    """Words in the text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def part(*keys: Column) -> Column:
    """A function of the keys to group by along with them.

    Groups by (keys, part) are the groups by keys, but are not laid out by keys alone. A join by the keys then gets an
    exchange of its own on this side too, which is what lets adaptive execution split a hot key on the other side.
    """
    return F.pmod(F.hash(*keys), F.lit(64)).alias("_part")


def with_fields(carried: dict[str, DataType], ddl: str) -> StructType:
    """A schema of carried columns, whatever their types and inner names, and those of the DDL string."""
    out = StructType()
    for name, kind in carried.items():
        out = out.add(name, kind)
    return StructType([*out.fields, *StructType.fromDDL(ddl).fields])
