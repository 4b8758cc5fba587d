"""The union of candidates over passes: keys, the folding union, severity votes and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.functions.endpoint import candidate_endpoint
from siftstone.functions.text import folded
from siftstone.operators.dedup import first_wins

CONFIRMED = "confirmed"
FIRST = ("title", "category", "endpoint", "symbol", "file", "line", "source")


def candidate_key(by_file: bool = False) -> Column:
    """What tells candidates apart, as text: a symbol in a file, else an endpoint, else a line, else the file; each with the class."""
    parts = lambda *cs: F.concat_ws("|", *cs)
    category, file = folded(F.col("category")), folded(F.col("file"))
    symbol = F.regexp_replace(F.element_at(F.split(folded(F.col("symbol")), r"\."), -1), "[^a-z0-9_]", "")
    endpoint = candidate_endpoint(F.col("endpoint"))
    named = F.coalesce(F.col("endpoint"), F.lit("")) != ""
    by_endpoint = parts(F.lit("fc"), file, category, endpoint) if by_file else parts(F.lit("ep"), endpoint, category)
    return F.when(symbol != "", parts(F.lit("sym"), file, category, symbol)).when(named, by_endpoint).when(F.col("line").isNotNull(), parts(F.lit("fl"), file, category, F.col("line").cast("string"))).otherwise(parts(F.lit("fc"), file, category))


def _evidence(rows: Column) -> Column:
    """Evidence in order, parted by ``; ``; one that the text so far contains is left out."""

    def step(acc: Column, x: Column) -> Column:
        new = F.coalesce(x["evidence"], F.lit(""))
        return F.when((new == "") | F.contains(acc, new), acc).when(acc == "", new).otherwise(F.concat(acc, F.lit("; "), new))

    return F.aggregate(rows, F.lit("").cast("string"), step)


def fold(candidates: DataFrame, by_file: bool = False, key: Column | None = None, votes: Column | None = None) -> DataFrame:
    """One row a key: the first row's fields, the evidence of all in order, confirmed if any is, all models, the upper middle severity.

    Only evidence needs an order. Repeated evidence of a key is dropped before its rows are gathered (a text that was
    seen is contained in the fold, so that changes nothing): a hot key's array has its distinct texts only. All other
    fields are partial aggregates. votes: how many rows a row stands for.
    """
    keyed = candidates.withColumn("key", candidate_key(by_file) if key is None else key)
    first = F.min_by(F.struct(*FIRST, "found_by", "severity"), "seq")
    level = severity.normalize(F.col("severity"))
    heads = keyed.groupBy("key").agg(first.alias("first"), F.min("seq").alias("seq"), F.max((F.col("status") == CONFIRMED).cast("int")).alias("confirmed"), F.min_by("status", "seq").alias("status"), severity.median_level(level, votes).alias("median"), (F.count("*") if votes is None else F.sum(votes)).cast("long").alias("n_rows"))
    models = keyed.select("key", F.explode("found_by").alias("model")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("model")).alias("models"))
    texts = keyed.groupBy("key", "evidence").agg(F.min("seq").alias("seq")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "evidence"))).alias("texts"))
    joined = heads.join(texts, "key").join(models, "key", "left")
    found_by = F.when(F.col("n_rows") == 1, F.col("first.found_by")).otherwise(F.coalesce("models", F.array().cast("array<string>")))
    return joined.select("key", "seq", *(F.col(f"first.{c}").alias(c) for c in FIRST), F.col("median").alias("severity"), _evidence(F.col("texts")).alias("evidence"), F.when(F.col("confirmed") == 1, CONFIRMED).otherwise(F.col("status")).alias("status"), found_by.alias("found_by"), "n_rows")


def new_keys_per_pass(candidates: DataFrame, by_file: bool = False) -> DataFrame:
    """(pass_no, n_new): how many keys each pass has that none before it had."""
    firsts = candidates.select(candidate_key(by_file).alias("key"), "pass_no").groupBy("key").agg(F.min("pass_no").alias("pass_no"))
    return firsts.groupBy("pass_no").agg(F.count("*").alias("n_new"))


def consensus(found_by: Column) -> Column:
    """How many different models found it."""
    return F.size(F.array_distinct(found_by))


def kept_rows(candidates: DataFrame, by_file: bool = False) -> DataFrame:
    """The first row of each key, nothing folded."""
    return first_wins(candidates, [candidate_key(by_file)])


def resume_key(*parts: Column) -> Column:
    """A key as text; a missing part is ``None``, so that it stays in its place."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def reloaded(saved: DataFrame) -> DataFrame:
    """Saved candidates with the default severity where none was stored."""
    return saved.withColumn("severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit(severity.DEFAULT)))
