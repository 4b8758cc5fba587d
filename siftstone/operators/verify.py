"""Verification: votes and confirmations into verdicts, and the route that findings take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.location import control_ref, on_file
from siftstone.functions.text import strip


def skeptic_verdict(parsed: Column, real: Column, controls: Column, shown: Column) -> Column:
    """A vote: null (an error) if the reply wasn't parsed; else whether the finding stays.

    It stays if the reply calls it real, or refutes it by a control in a file (of ``controls``) that wasn't among the
    ``shown`` paths.
    """
    refs = F.filter(F.transform(F.coalesce(controls, F.array().cast("array<string>")), control_ref), lambda r: r != "")
    unseen = F.exists(refs, lambda r: ~F.exists(shown, lambda p: on_file(r, p)))
    return F.when(parsed, F.coalesce(real, F.lit(False)) | unseen)


def agent_verdict(parsed: Column, real: Column) -> Column:
    """As skeptic_verdict, without a look at files."""
    return F.when(parsed, F.coalesce(real, F.lit(False)))


def confirmer_holds(parsed: Column, holds: Column, code: Column) -> Column:
    """Whether a refutation holds: not without readable code or a parsed reply."""
    return F.coalesce(parsed & holds & (strip(code) != ""), F.lit(False))


def tally(votes: DataFrame) -> DataFrame:
    """(key, n_completed, any_real, errors, reason) of votes (key, vote_no, completed, real, reason)."""
    done = F.col("completed")
    return votes.groupBy("key").agg(F.count_if(done).alias("n_completed"), F.coalesce(F.max(F.when(done, F.col("real"))), F.lit(False)).alias("any_real"), F.count_if(~done).alias("errors"), F.min_by("reason", F.when(done & ~F.col("real"), F.col("vote_no"))).alias("reason"))


def applicable(candidates: DataFrame, confirmers: DataFrame) -> DataFrame:
    """(key, label): confirmers (label) that aren't a model which found the candidate (key, found_by); no label is always one.

    Confirmers are configuration, the models of a run: each candidate carries the list of them, so this isn't a join;
    over a hundred are taken for a wrong table.
    """
    labels = [r["label"] or "" for r in confirmers.select("label").distinct().limit(101).collect()]
    if len(labels) > 100:
        raise ValueError("over 100 confirmers")
    known = F.filter(F.array(*map(F.lit, labels)).cast("array<string>"), lambda x: (x == "") | ~F.array_contains("found_by", x))
    return candidates.select("key", F.explode(known).alias("label"))


def verdicts(votes: DataFrame, confirmations: DataFrame) -> DataFrame:
    """(key, real, incomplete, errors, reason).

    A finding is refuted only if a vote was completed, all completed ones refute it, and every applicable confirmer
    (one at least) completed and upholds it. confirmations: (key, label, completed, holds), the applicable ones.
    """
    upheld = confirmations.groupBy("key").agg(F.min(F.col("completed") & F.col("holds")).alias("all_hold"), F.min("completed").alias("all_done"))
    rows = tally(votes).join(upheld, "key", "left")
    none, refuted = F.col("n_completed") == 0, F.col("n_completed").cast("boolean") & ~F.col("any_real")
    broken = refuted & F.coalesce(~F.col("all_done"), F.lit(False))
    dropped = refuted & ~broken & F.coalesce("all_hold", F.lit(False))
    return rows.select("key", (~dropped).alias("real"), (none | broken).alias("incomplete"), (F.col("errors") + broken.cast("int")).alias("errors"), F.when(dropped, F.coalesce("reason", F.lit(""))).otherwise("").alias("reason"))


def totals(verified: DataFrame) -> DataFrame:
    """One row: confirmed, refuted, errors, incomplete."""
    return verified.agg(F.count_if(F.col("real")).alias("confirmed"), F.count_if(~F.col("real")).alias("refuted"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.count_if(F.col("real") & F.col("incomplete")).alias("incomplete"))


def route(findings: DataFrame, located: Column, verified: DataFrame, consensus: int = 2) -> DataFrame:
    """findings (key, models) with ``step``: consensus (enough models, not verified), unlocatable, refuted, kept or verified.

    A finding without a verdict counts as real.
    """
    seen = verified.select(F.col("key").alias("_key"), "real", "incomplete")
    rows = findings.withColumn("_located", located).join(seen, F.col("key") == F.col("_key"), "left")
    agreed = F.col("models") >= consensus
    step = F.when(agreed, "consensus").when(~F.col("_located"), "unlocatable").when(~F.coalesce("real", F.lit(True)), "refuted").when(F.coalesce("incomplete", F.lit(True)), "kept").otherwise("verified")
    return rows.withColumn("step", step).drop("_key", "_located", "real", "incomplete")


def open_items(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Items that aren't done yet, for a run that is resumed."""
    return items.join(done.select(key).distinct(), key, "left_anti")
