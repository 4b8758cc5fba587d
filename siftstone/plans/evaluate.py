"""Evaluation: reports against answer keys, over runs, compared and gated."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators import compare, score


@dataclass(frozen=True)
class Evaluation:
    """outcomes: (target, run, id, outcome); summary: one row a target."""

    outcomes: DataFrame
    summary: DataFrame


def evaluate(runs: list[DataFrame], key: DataFrame, errors: list[int] | None = None) -> Evaluation:
    """Runs of reports against a key, folded by strict majority. errors: failed steps of each run.

    All runs are scored at once, each with a target of its own: ``<run>:<target>``.
    """
    own = lambda df, i: df.withColumn("target", F.concat(F.lit(f"{i}:"), F.col("target")))
    heads, scored, keys = [], [], []
    for i, reports in enumerate(runs):
        n = reports.groupBy("target").agg(F.count("*").alias("n_reports"))
        heads.append(n.select("target", F.lit(i).alias("run"), "n_reports", F.lit(errors[i] if errors else 0).alias("errors")))
        scored.append(own(reports.select("target", "seq", "name", "endpoint", "category", "files", "text"), i))
        keys.append(own(key, i))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    outcomes, head = score.outcomes(union(scored), union(keys)), union(heads)
    place = F.split("target", ":", 2)
    outcomes = outcomes.select(place[1].alias("target"), "id", "outcome", place[0].cast("int").alias("run"))
    folded = score.fold_runs(outcomes).withColumn("runs", F.lit(len(runs)).cast("long"))
    return Evaluation(outcomes, score.folded_summary(folded, head))


def majority_outcomes(evaluation: Evaluation, n_runs: int) -> DataFrame:
    """(id, outcome) by strict majority over the runs."""
    folded = score.fold_runs(evaluation.outcomes)
    runs = F.lit(n_runs)
    found = F.when(score.majority(F.col("found"), runs), "found").when(F.col("planted"), "missed")
    outcome = F.when(score.majority(F.col("fp"), runs), "false_positive").otherwise(found)
    return folded.select("id", outcome.alias("outcome")).where("outcome is not null")


def gate(before: Evaluation | None, after: Evaluation, n_runs: int, floor: float = 0.0) -> DataFrame:
    """The failures of a move from before to after, over all targets."""
    totals = after.summary.agg(F.sum("errors").alias("errors"), F.min("precision_known").alias("precision")).first()  # one row
    old = None if before is None else majority_outcomes(before, n_runs)
    return compare.regression_gate(old, majority_outcomes(after, n_runs), F.lit(totals["errors"] or 0), F.lit(totals["precision"]), floor)
