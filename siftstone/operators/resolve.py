"""Locations resolved against the files of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.location import is_unsafe
from siftstone.functions.text import basename


def basename_index(files: DataFrame) -> DataFrame:
    """(name, path, n): for each file name how many paths have it, and the least of them."""
    return files.select(basename(F.col("path")).alias("name"), "path").groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def resolve_paths(refs: DataFrame, files: DataFrame, ref: str = "file") -> DataFrame:
    """refs with ``resolved``: the path itself if there is such a file, else the only file of its name, else null."""
    paths = files.select(F.col("path").alias("_exact")).distinct()
    unique = basename_index(files).where("n = 1").select(F.col("name").alias("_name"), F.col("path").alias("_only"))
    out = refs.withColumn("_ref", F.when(~is_unsafe(F.col(ref)), F.col(ref)))
    out = out.join(paths, F.col("_ref") == F.col("_exact"), "left").join(unique, basename(F.col("_ref")) == F.col("_name"), "left")
    return out.withColumn("resolved", F.coalesce("_exact", "_only")).drop("_ref", "_exact", "_name", "_only")


def contained_paths(refs: DataFrame, files: DataFrame, ref: str = "file") -> DataFrame:
    """refs that name an existing file by a safe relative path."""
    return refs.where(~is_unsafe(F.col(ref))).join(files.select(F.col("path").alias(ref)).distinct(), ref, "left_semi")


def verify_text(refs: DataFrame, files: DataFrame, most: int = 40_000, ref: str = "file") -> DataFrame:
    """refs with ``code``: the first characters of the resolved file, empty without one."""
    texts = files.select(F.col("path").alias("_path"), F.left("text", F.lit(most)).alias("_code"))
    return resolve_paths(refs, files, ref).join(texts, F.col("resolved") == F.col("_path"), "left").withColumn("code", F.coalesce("_code", F.lit(""))).drop("_path", "_code")
