"""Review of repositories: seeding, replayed runs, finalization of candidate notes, and the gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.category import canonical
from siftstone.operators import chunk, dedup, filters, passes, resolve, union, verify
from siftstone.plans.seams import Provider, reviewed
from siftstone.sources import checkpoint

Rules = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class Effort:
    """How much review: shots of each lens and votes on each finding."""

    shots: int
    votes: int

    def max_passes(self, n_lenses: int) -> int:
        return (self.shots + 1) * n_lenses


#: Presets by name.
EFFORT = {"low": Effort(1, 1), "medium": Effort(2, 1), "high": Effort(3, 2)}


def seeded_units(files: DataFrame, rules: Rules, globs: Sequence[str], markers: Sequence[str], exports: Sequence[str], layers: Sequence[str], max_units: int | None = None) -> DataFrame:
    """Units of a repository's entry points, or of its exported files where it has none; too many units, or none, raise ValueError."""
    path, text = F.col("path"), F.col("text")
    entries = files.where(filters.is_entrypoint(path, text, rules, globs, markers))
    if entries.isEmpty():
        entries = files.where(filters.is_public_api(path, text, rules, exports))
    units = chunk.review_units(entries.select("path", "text"), files.where(filters.is_logic_layer(path, rules, layers)).select("path"))
    n = units.limit((max_units or 1) + 1).count()
    if not n:
        raise ValueError("no unit to review")
    if max_units and n > max_units:
        raise ValueError(f"over {max_units} units")
    return units


def run(candidates: DataFrame, passes_: DataFrame, aliases: DataFrame, by_file: bool = False, n_lenses: int = 1, effort: str = "medium") -> DataFrame:
    """The union of a replayed run: passes up to convergence, folded on raw categories, then canonical; collapsed where files tell findings apart."""
    level = EFFORT[effort]
    made = passes.replay(candidates, passes_, by_file, n_lenses=n_lenses, shots=level.shots, max_passes=level.max_passes(n_lenses))
    merged = canonical(union.fold(made, by_file), "category", aliases)
    return dedup.collapse_colocated(merged) if by_file else merged


def finalize(candidates: DataFrame, aliases: DataFrame, by_file: bool = False) -> DataFrame:
    """The union of an agent's candidates: canonical categories first, then folded, and always collapsed."""
    return dedup.collapse_colocated(union.fold(canonical(candidates, "category", aliases), by_file))


def resumed(units: DataFrame, done: DataFrame, saved: DataFrame | None) -> DataFrame:
    """Units still open; reviewed units without a saved union raise ValueError."""
    if saved is None and not done.isEmpty():
        raise ValueError("units are marked reviewed, but there is no union")
    return verify.open_items(units, done, "unit")


def verified(findings: DataFrame, files: DataFrame, votes: DataFrame, confirmations: DataFrame, models: int = 2) -> DataFrame:
    """Findings with ``step`` (see verify.route) by their votes and confirmations."""
    located = resolve.resolve_paths(findings.withColumn("models", union.consensus(F.col("found_by"))), files)
    return verify.route(located, F.col("resolved").isNotNull(), verify.verdicts(votes, confirmations), models)


def live(units: DataFrame, providers: dict[str, Provider], lenses: Sequence[str], path: str, by_file: bool = False, effort: str = "medium", quiet: int = passes.QUIET) -> tuple[DataFrame, dict]:
    """Review units (unit, prompt) pass by pass until a run of clean passes adds nothing and every lens had its shots.

    Each pass's candidates and reviews are written below ``path`` before the next begins; a pass that is there already
    isn't made again, so a run that broke off goes on. A pass also leaves the keys that it was the first to have: the next
    one's keys are held against these alone, each of which is there once, and the candidates of all passes are read once,
    for the union. Only counts come to the driver. Returns the union and the status.
    """
    spark, level, names = units.sparkSession, EFFORT[effort], list(providers)
    most, state = level.max_passes(len(lenses)), {"converged": False, "passes": 0, "errors": 0}
    still = 0
    for n in range(1, most + 1):
        lens, model = lenses[(n - 1) % len(lenses)], names[(n - 1) // len(lenses) % len(names)]
        place = f"{path}/pass-{n:04d}"
        if not checkpoint.exists(spark, f"{place}/reviews"):
            asked = units.select("unit", F.lit(n).alias("pass_no"), F.concat(chunk.lens_header(F.lit(lens)), F.lit("\n\n"), "prompt").alias("prompt"))
            found, reviews = reviewed(asked, providers[model])
            found = found.withColumns({"status": F.lit("open"), "source": F.lit("review"), "found_by": F.array(F.lit(model))})
            checkpoint.save(found.withColumn("seq", F.lit(n).cast("long") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)), f"{place}/candidates")
            checkpoint.save(reviews, f"{place}/reviews")
        if not checkpoint.exists(spark, f"{place}/new_keys"):
            keys = checkpoint.load(spark, f"{place}/candidates").select(union.candidate_key(by_file).alias("key")).distinct()
            known = [f"{path}/pass-{i:04d}/new_keys" for i in range(1, n)]
            checkpoint.save(keys.join(spark.read.schema("key string").parquet(*known), "key", "left_anti") if known else keys, f"{place}/new_keys")
        failed = checkpoint.load(spark, f"{place}/reviews").where("not ok").count()
        new = checkpoint.load(spark, f"{place}/new_keys", "key string").count()
        still = still + 1 if not new and not failed else 0
        state = {"converged": still >= quiet and n // len(lenses) >= level.shots, "passes": n, "errors": state["errors"] + failed}
        if state["converged"]:
            break
    made = spark.read.parquet(*(f"{path}/pass-{i:04d}/candidates" for i in range(1, state["passes"] + 1)))
    return union.fold(made, by_file), state
