"""Adversarial review: a finder, a challenger and a judge in rounds, over all diffs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import coerce
from siftstone.operators.dedup import PLACE_KEY, first_wins
from siftstone.plans.seams import Provider, ask
from siftstone.sources import checkpoint

ROUNDS = 3


@dataclass(frozen=True)
class Rounds:
    """findings: (diff_id, seq, ...); status: (diff_id, rounds, converged, degraded)."""

    findings: DataFrame
    status: DataFrame


def _found(replies: DataFrame) -> DataFrame:
    rows = replies.select("diff_id", F.posexplode(coerce.findings(F.col("reply"))).alias("seq", "x"))
    return rows.select("diff_id", F.col("seq").cast("long").alias("seq"), "x.*")


def _unique(findings: DataFrame) -> DataFrame:
    return first_wins(findings, [F.col("diff_id"), *(F.col(c) for c in PLACE_KEY)])


def without_judge(findings: DataFrame, challenged: DataFrame) -> DataFrame:
    """The findings less what the challenger dismissed, with what it found anew, each place once. challenged: (diff_id, reply)."""
    parsed = challenged.select("diff_id", F.from_json("reply", "dismissed array<string>")["dismissed"].alias("targets"))
    gone = parsed.select("diff_id", F.explode("targets").alias("target"))
    kept = findings.join(gone.where("target is not null").groupBy("diff_id").agg(F.collect_set("target").alias("_gone")), "diff_id", "left")
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    left = kept.where(F.col("_gone").isNull() | ~(F.array_contains("_gone", place) | F.array_contains("_gone", F.col("file")))).drop("_gone")
    return _unique(left.unionByName(_found(challenged).withColumn("seq", F.col("seq") + 1_000_000)))


def rounds(diffs: DataFrame, finder: Provider, challenger: Provider, judge: Provider, path: str, most: int = ROUNDS) -> Rounds:
    """Review diffs (diff_id, text): each round asks all three about the diffs still open, and writes its state below ``path``.

    A diff is done when the judge leaves nothing to investigate and agrees, or gives the places that it gave before. If
    the judge's reply can't be used, the round ends without it and the diff is marked degraded.
    """
    spark = diffs.sparkSession
    state = diffs.select("diff_id", "text", F.lit("").alias("last"), F.lit(0).alias("rounds"), F.lit(False).alias("converged"), F.lit(False).alias("degraded"))
    found = spark.createDataFrame([], "diff_id long, seq long, file string, line int, severity string, category string, description string, exploit_scenario string, recommendation string, confidence double")
    for n in range(1, most + 1):
        open_ = state.where("not converged and not degraded")
        if open_.isEmpty():
            break
        first = ask(open_.select("diff_id", F.concat(F.lit("find\n"), "text").alias("prompt")), finder)
        second = ask(open_.join(first.select("diff_id", F.col("reply").alias("_first")), "diff_id").select("diff_id", F.concat(F.lit("challenge\n"), F.coalesce("_first", F.lit("")), F.lit("\n"), "text").alias("prompt")), challenger)
        third = ask(second.select("diff_id", F.concat(F.lit("judge\n"), F.coalesce("reply", F.lit(""))).alias("prompt")), judge)
        checkpoint.save(first.withColumn("seat", F.lit("finder")).unionByName(second.withColumn("seat", F.lit("challenger"))).unionByName(third.withColumn("seat", F.lit("judge"))), f"{path}/round-{n}/replies")
        replies = checkpoint.load(spark, f"{path}/round-{n}/replies")
        seat = lambda name: replies.where(F.col("seat") == name).select("diff_id", "reply", "ok")  # noqa: B023, E731
        judged = seat("judge").withColumn("x", F.from_json("reply", "agreed boolean, investigate array<string>, findings array<struct<file:string>>"))
        judged = judged.select("diff_id", "reply", (F.col("ok") & F.col("x.findings").isNotNull()).alias("usable"), F.coalesce("x.agreed", F.lit(False)).alias("agreed"), F.greatest(F.size("x.investigate"), F.lit(0)).alias("n_open"))
        good, bad = judged.where("usable"), judged.where("not usable").select("diff_id")
        settled = _unique(_found(good.select("diff_id", "reply")))
        fallback = without_judge(_found(seat("finder")).join(bad, "diff_id", "left_semi"), seat("challenger").join(bad, "diff_id", "left_semi"))
        now = settled.unionByName(fallback)
        keys = now.groupBy("diff_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set(F.concat_ws(":", *PLACE_KEY)))), 256).alias("keys"))
        ended = judged.select("diff_id", "usable", "agreed", "n_open").join(keys, "diff_id", "left").withColumn("keys", F.coalesce("keys", F.lit("none")))
        done = F.col("usable") & (F.col("n_open") == 0) & (F.col("agreed") | (F.col("keys") == F.col("last")))
        moved = open_.join(ended, "diff_id").select("diff_id", "text", F.col("keys").alias("last"), F.lit(n).alias("rounds"), done.alias("converged"), (~F.col("usable")).alias("degraded"))
        checkpoint.save(state.join(open_.select("diff_id"), "diff_id", "left_anti").unionByName(moved), f"{path}/round-{n}/state")
        checkpoint.save(found.join(judged.select("diff_id"), "diff_id", "left_anti").unionByName(now), f"{path}/round-{n}/findings")
        state, found = (checkpoint.load(spark, f"{path}/round-{n}/{x}") for x in ("state", "findings"))
    return Rounds(found, state.select("diff_id", "rounds", "converged", "degraded"))

