"""Multi-pass review, replayed: convergence, lens coverage, model rotation and the pass to stop at, without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.operators.union import new_keys_per_pass

QUIET, MAX_PASSES = 2, 24


def lens_of(pass_no: Column, n_lenses: int) -> Column:
    """The lens of a pass, both from 1 and 0: they take turns."""
    return F.pmod(pass_no - 1, F.lit(n_lenses))


def model_of(pass_no: Column, n_lenses: int, n_models: int) -> Column:
    """The model of a pass: the next one after each round of lenses."""
    return F.pmod(F.floor((pass_no - 1) / n_lenses), F.lit(n_models)).cast("int")


def lenses_covered(pass_no: Column, n_lenses: int, shots: int) -> Column:
    """Whether every lens has had its shots by this pass."""
    return F.floor(pass_no / n_lenses) >= shots


def convergence(new: DataFrame, passes: DataFrame, quiet: int = QUIET, n_lenses: int = 1, shots: int = 0) -> DataFrame:
    """Each pass with what it added and whether the last ``quiet`` passes were clean and added nothing. One row a pass."""
    last = Window.orderBy("pass_no").rowsBetween(1 - quiet, 0)
    all_ = passes.join(new, "pass_no", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    still = (F.sum("n_new").over(last) == 0) & F.min("clean").over(last) & (F.count("*").over(last) == quiet)
    return all_.select("pass_no", "n_new", "clean", still.alias("converged"), lenses_covered(F.col("pass_no"), n_lenses, shots).alias("covered"))


def stop_pass(state: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row: the first pass that converged with all lenses covered, else the last allowed; and which of the two."""
    first = F.min(F.when(F.col("converged") & F.col("covered") & (F.col("pass_no") <= max_passes), F.col("pass_no")))
    last = F.least(F.max("pass_no"), F.lit(max_passes))
    return state.agg(F.coalesce(first, last).alias("stop_at"), first.isNotNull().alias("converged"))


def replay(candidates: DataFrame, passes: DataFrame, by_file: bool = False, quiet: int = QUIET, n_lenses: int = 1, shots: int = 0, max_passes: int = MAX_PASSES) -> DataFrame:
    """The candidates of the passes that a live run would have made before it stopped."""
    state = convergence(new_keys_per_pass(candidates, by_file), passes, quiet, n_lenses, shots)
    return candidates.where(F.col("pass_no") <= stop_pass(state, max_passes).select("stop_at").scalar())


def failed_units(reviews: DataFrame) -> DataFrame:
    """Units without one clean review in any pass."""
    return reviews.groupBy("unit").agg(F.max(F.col("ok").cast("int")).alias("ok")).where("ok = 0 or ok is null").select("unit")


def rounds_converged(keys: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per round of finder, challenger and judge: whether it is final. keys: (round, file, line, category); verdicts: (round, agreed, n_open).

    A round is final if nothing is left to investigate and the judge agreed or the set of keys is that of the round before.
    """
    digest = F.xxhash64("file", "line", "category")
    sets = keys.distinct().groupBy("round").agg(F.count("*").alias("n_keys"), F.sum(digest.cast("decimal(20,0)")).alias("digest"))
    rows = verdicts.join(sets, "round", "left").fillna(0, ["n_keys"]).withColumn("digest", F.coalesce("digest", F.lit(0).cast("decimal(30,0)")))
    order = Window.orderBy("round")  # one row a round
    same = (F.lag("digest").over(order) == F.col("digest")) & (F.lag("n_keys").over(order) == F.col("n_keys"))
    return rows.select("round", "n_keys", ((F.coalesce(F.col("agreed"), F.lit(False)) | F.coalesce(same, F.lit(False))) & (F.coalesce("n_open", F.lit(0)) == 0)).alias("final"))
