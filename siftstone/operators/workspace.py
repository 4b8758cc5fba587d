"""The notes that a review's workspace begins with, and the texts of gates, coverage and comparisons. One row or one row a note each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.compare import flips
from siftstone.operators.coverage import COUNTERS


def _lines(df: DataFrame, order: list[str], line: Column, none: str) -> DataFrame:
    """One row: the lines in order, one below the other; ``none`` if there is no row. What is listed is one note's, so one task's."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    text = F.array_join(F.transform(rows, lambda x: x["_line"]), "\n")
    return df.agg(F.when(F.count("*") == 0, none).otherwise(text).alias("text"))


def stack_note(guides: DataFrame) -> DataFrame:
    """One row: the detected stack by kind, then the bodies of its guides (seq, id, kind, body) in order."""
    ids = lambda kind: F.coalesce(F.nullif(F.array_join(F.transform(F.filter("xs", lambda x: x["kind"] == kind), lambda x: x["id"]), ", "), F.lit("")), F.lit("-"))
    rows = guides.agg(F.array_sort(F.collect_list(F.struct("seq", "id", "kind", "body"))).alias("xs"))
    head = F.concat_ws("\n", F.lit("# Stack\n"), *(F.concat(F.lit(f"{label}: "), ids(kind)) for label, kind in (("Languages", "language"), ("Frameworks", "framework"), ("Protocols", "protocol"))))
    whole = F.concat(head, F.array_join(F.transform("xs", lambda x: F.concat(F.lit("\n\n---\n\n"), x["body"])), ""))
    return rows.select(F.when(F.size("xs") == 0, "# Stack\n\nNo guide fits.").otherwise(whole).alias("text"))


def entrypoint_note(entrypoints: DataFrame, layers: DataFrame, note: str = "") -> DataFrame:
    """One row: the files (path) that may define entry points and those to trace into."""
    listed = lambda df: _lines(df, ["path"], F.concat(F.lit("- "), "path"), "(none)")
    one = listed(entrypoints).withColumnRenamed("text", "a").withColumn("_one", F.lit(1))
    two = listed(layers).withColumnRenamed("text", "b").withColumn("_one", F.lit(1))
    head = "# Entry points\n" + (f"\nNote: {note}\n" if note else "")
    return one.join(two, "_one").select(F.concat(F.lit(f"{head}\n## May define entry points\n\n"), "a", F.lit("\n\n## To trace into\n\n"), "b").alias("text"))


def class_note(vulns: DataFrame) -> DataFrame:
    """One row: the bodies of all classes (id, body) by id."""
    return _lines(vulns, ["id"], F.concat(F.lit("---\n\n"), "body"), "(none)").select(F.concat(F.lit("# Classes\n\n"), "text").alias("text"))


def target_note(meta: DataFrame) -> DataFrame:
    """(address, text): a report's section on where its source comes from; meta: (address, field, value), only what is known."""
    rows = F.array_sort(F.collect_list(F.struct("field", "value")))
    return meta.groupBy("address").agg(F.concat(F.lit("## Target\n\n"), F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- "), x["field"], F.lit(": "), x["value"])), "\n")).alias("text"))


def gate_text(fails: DataFrame, target: str) -> DataFrame:
    """One row: PASS, or FAIL with a line for each failure (rule, detail)."""
    rows = _lines(fails, ["rule", "detail"], F.concat(F.lit("  - "), "rule", F.lit(": "), "detail"), "")
    n = fails.agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    both = rows.withColumn("_one", F.lit(1)).join(n, "_one")
    return both.select(F.when(F.col("n") == 0, f"gate PASS: {target}").otherwise(F.concat(F.lit(f"gate FAIL: {target}, "), F.col("n").cast("string"), F.lit(" blocking\n"), "text")).alias("text"))


def coverage_lines(covered: DataFrame) -> DataFrame:
    """(kind, ref, line) of the coverage matrix with flags, a line an item."""
    source = F.coalesce(F.nullif(F.concat_ws("/", *(F.when(F.col(c) > 0, c) for c in COUNTERS[4:])), F.lit("")), F.lit("-"))
    used = F.col("diff_positive") + F.col("diff_safe") + F.col("repository_planted") + F.col("repository_safe")
    flag = F.when(used == 0, "UNCOVERED").when((F.col("kind") == "vulnerability") & (F.col("repository_planted") == 0), "REPOSITORY-UNCOVERED").otherwise("")
    return covered.select("kind", "ref", F.rtrim(F.concat_ws(" ", "ref", *(F.col(c).cast("string") for c in COUNTERS[:4]), source, flag)).alias("line"))


def coverage_text(covered: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: the matrix by (kind, ref), then the problems by (kind, ref)."""
    table = _lines(coverage_lines(covered), ["kind", "ref"], F.col("line"), "(no knowledge)").withColumnRenamed("text", "a").withColumn("_one", F.lit(1))
    gaps = _lines(problems, ["kind", "ref", "detail"], F.rtrim(F.concat(F.lit("["), "kind", F.lit("] "), "ref", F.lit(" "), "detail")), "none").withColumnRenamed("text", "b").withColumn("_one", F.lit(1))
    return table.join(gaps, "_one").select(F.concat(F.lit("# Coverage\n"), "a", F.lit("\n\n# Problems\n"), "b").alias("text"))


def compare_text(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """One row: a line for each kind of flip with its ids in order."""
    rows = flips(before, after).groupBy("flip").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ", ").alias("ids"))
    return _lines(rows, ["flip"], F.concat(F.lit("  "), F.replace("flip", F.lit("_"), F.lit(" ")), F.lit(": "), "ids"), "  no flips").select(F.concat(F.lit(f"compare: {target}\n"), "text").alias("text"))


def imported_invariants(existing: str | None, template: str, imported: str | None) -> tuple[str, str]:
    """(text, note): an imported file takes the template's place, never that of an edited one; without one the text stays, or begins as the template."""
    if imported is None:
        return (template if existing is None else existing), ""
    if existing is not None and existing != template:
        return existing, "the edited invariants already match" if existing == imported else "the edited invariants stay; the import is ignored"
    return imported, "invariants imported"
