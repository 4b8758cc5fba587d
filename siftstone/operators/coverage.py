"""Coverage of knowledge by cases and benchmarks: the matrix and its problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.order import numbered

from siftstone.functions.category import category_of

COUNTERS = ("diff_positive", "diff_safe", "repository_planted", "repository_safe", "public", "private")


def case_refs(knowledge: Column, category: Column) -> Column:
    """The knowledge that a diff case exercises: what it names, else its category's class."""
    own = F.when(category != "", F.array(F.concat(F.lit("vuln:"), category_of(category)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(knowledge) > 0, knowledge).otherwise(own)


def uses(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref, kind, provenance): each use of a ref by a diff case (refs, positive) or an answer key entry (refs, planted, provenance)."""
    by_case = cases.select(F.explode("refs").alias("ref"), F.when(F.col("positive"), "diff_positive").otherwise("diff_safe").alias("kind"), F.lit("public").alias("provenance"))
    by_entry = entries.select(F.explode("refs").alias("ref"), F.when(F.col("planted"), "repository_planted").otherwise("repository_safe").alias("kind"), "provenance")
    return by_case.unionByName(by_entry)


def matrix(items: DataFrame, used: DataFrame) -> DataFrame:
    """Each knowledge item (ref, kind) with six counters; a ref without an item isn't in it."""
    counts = used.groupBy("ref").agg(*(F.count_if(F.col("kind") == c).alias(c) for c in COUNTERS[:4]), *(F.count_if(F.col("provenance") == c).alias(c) for c in COUNTERS[4:]))
    return items.join(counts, "ref", "left").fillna(0, list(COUNTERS))


def problems(cov: DataFrame, referenced: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, ref, detail): classes without a positive, a safe or a planted case; refs (ref, origin) without an item; entries (id, refs) without refs."""
    classes = cov.where("kind = 'vulnerability'")
    missing = lambda counter, kind: classes.where(F.col(counter) == 0).select(F.lit(kind).alias("kind"), "ref", F.lit("").alias("detail"))
    unresolved = referenced.join(cov.select("ref"), "ref", "left_anti").select(F.lit("unresolved-reference").alias("kind"), "ref", F.col("origin").alias("detail"))
    bare = entries.where(F.size("refs") <= 0).select(F.lit("entry-without-knowledge").alias("kind"), F.col("id").cast("string").alias("ref"), F.lit("").alias("detail"))
    return missing("diff_positive", "missing-positive").unionByName(missing("diff_safe", "missing-safe")).unionByName(missing("repository_planted", "missing-repository-target")).unionByName(unresolved).unionByName(bare)


def in_order(problems_: DataFrame) -> DataFrame:
    """Problems by kind, ref and detail, with their ``place`` from 0 in that order."""
    return numbered(problems_, [], ["kind", "ref", "detail"], "place").orderBy("place")


def referenced(benchmarks: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref, origin): every ref that a benchmark's manifest (id, refs) or an entry (benchmark, id, refs) names."""
    by_manifest = benchmarks.select(F.explode("refs").alias("ref"), F.concat(F.lit("manifest "), "id").alias("origin"))
    return by_manifest.unionByName(entries.select(F.explode("refs").alias("ref"), F.concat_ws(" ", F.lit("entry"), "benchmark", "id").alias("origin")))


def covered(c: DataFrame) -> DataFrame:
    """The matrix with flags: whether cases and whether benchmarks cover each item both ways."""
    return c.withColumns({"diff_covered": (F.col("diff_positive") > 0) & (F.col("diff_safe") > 0), "repository_covered": F.col("repository_planted") > 0})
