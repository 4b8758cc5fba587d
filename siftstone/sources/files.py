"""Repositories as tables of files: (path, text, size)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import directories, suffix
from siftstone.operators.chunk import within_budget
from siftstone.operators.filters import is_skipped_dir

MAX_BYTES = 2_000_000
SAMPLE, SAMPLE_TOTAL = 16_000, 8_000_000


def read_tree(spark: SparkSession, root: str, rules: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """All files below a folder of any store, paths relative to it.

    Paths and sizes are listed first, without any content (the source leaves out columns that aren't asked for); files
    in skipped folders, too large ones, and links of a local folder that lead out of it are left out before what is
    left is read. The list of paths is on the driver, as any listing of files is.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    relative = F.regexp_replace(F.substring_index("path", f"{base}/", -1), "^/+", "")
    listed = raw.load(root).select(F.col("path").alias("place"), relative.alias("path"), F.col("length").alias("size"))
    if rules is not None:
        listed = listed.where(~is_skipped_dir(directories(F.col("path")), rules))
    rows = listed.collect()
    if "://" not in root or root.startswith("file:"):
        home = Path(root.removeprefix("file:")).resolve()
        rows = [r for r in rows if (home / r["path"]).resolve().is_relative_to(home)]
    large = [(r["path"], "", r["size"]) for r in rows if r["size"] > MAX_BYTES]
    places = [r["place"] for r in rows if r["size"] <= MAX_BYTES]
    out = spark.createDataFrame(large, "path string, text string, size long")
    if places:
        # marks of wildcards in names are names
        plain = [p.replace("\\", "\\\\").replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in places]
        read = raw.load(plain).withColumn("path", relative)
        out = out.unionByName(read.select("path", readable_text().alias("text"), F.col("length").alias("size")))
    return out


def readable_text(content: str = "content", size: str = "length"):
    """The content as text; empty if it is too large or no UTF-8."""
    text = F.try_validate_utf8(F.col(content).cast("string"))
    return F.when(F.col(size) > MAX_BYTES, "").otherwise(F.coalesce(text, F.lit("")))


def from_list(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """A files table of given (path, text) pairs, by path."""
    return from_rows(spark.createDataFrame(files, "path string, text string"))


def from_rows(rows: DataFrame) -> DataFrame:
    """A files table of rows (path, text), by path; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("path", text.alias("text"), F.octet_length(text).cast("long").alias("size")).orderBy("path")


def sampled_kinds(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """(extension, n): how many files each of the extensions has; those without a file too."""
    known = files.sparkSession.createDataFrame([(e,) for e in extensions], "extension string")
    n = files.groupBy(suffix(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))
    return known.join(n, "extension", "left").fillna(0, ["n"])


def manifest_text(files: DataFrame, manifests: Sequence[str]) -> DataFrame:
    """One row: the texts of the root's manifests, in the order of their names."""
    found = files.where(F.col("path").isin(*manifests)).select("path", "text")
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("text"))


def source_sample(files: DataFrame, extensions: Sequence[str], per_file: int = SAMPLE, total: int = SAMPLE_TOTAL, group: Sequence[str] = ()) -> DataFrame:
    """(path, text): the first characters of files with the extensions, by path, until the total is reached."""
    own = files.where(suffix(F.col("path")).isin(*extensions)).withColumn("_size", F.length("text")).withColumn("_all", F.lit(1))
    kept = within_budget(own, [*group, "_all"], ["path"], "_size", total, per_file)
    return kept.select(*group, "path", F.left("text", F.col("taken")).alias("text"))
