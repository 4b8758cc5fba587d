"""The completeness gate of a review, and what of a repository no unit owns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.functions.text import folded
from siftstone.operators.select import contained
from siftstone.session import checkpointed


#: Lengths of the strings that paths and tokens meet by.
GRAMS = (12, 6, 3, 1)


def unowned(inventory: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Inventory paths that no artifact text contains.

    A path without white space lies within one token of a text. Different tokens are cut into all their strings of a few
    lengths; a path is looked up by its own last characters, of the longest such length that it has, and then compared
    with the tokens found. So this is an equi-join, and a common token counts once. Paths with white space are
    searched for in the texts.
    """
    paths = inventory.select("path").distinct()
    plain, odd = paths.where(~F.rlike("path", F.lit(r"\s"))), paths.where(F.rlike("path", F.lit(r"\s")))
    tokens = checkpointed(artifacts.select(F.explode(F.split("text", r"\s+")).alias("token")).distinct().withColumn("id", F.monotonically_increasing_id()))
    own = F.coalesce(*(F.when(F.length("path") >= g, g) for g in GRAMS), F.lit(0))
    used = {r["g"] for r in plain.select(own.alias("g")).distinct().collect()}  # one of each length at most
    owned = plain.limit(0)
    for g in sorted(used & set(GRAMS)):
        grams = F.transform(F.sequence(F.lit(1), F.length("token") - g + 1), lambda i: F.substring(F.col("token"), i, F.lit(g)))  # noqa: B023
        found = tokens.where(F.length("token") >= g).select("id", F.explode(F.array_distinct(grams)).alias("gram"))
        keyed = plain.where(own == g).withColumn("gram", F.right("path", F.lit(g)))
        # the token's number travels with its strings, the token itself only to the paths that it may hold
        maybe = keyed.join(found, "gram").select("path", "id").distinct()
        owned = owned.unionByName(maybe.join(tokens, "id").where(F.contains("token", "path")).select("path"))
    left = plain.join(owned.distinct(), "path", "left_anti")
    return left.unionByName(odd.join(contained(artifacts.select("text"), odd.withColumnRenamed("path", "needle")).select(F.col("needle").alias("path")).distinct(), "path", "left_anti"))


def completeness(units: DataFrame, candidates: DataFrame, n_surface: int | None, converged: bool | None, unowned_files: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(check, level, n): each check with how many break it; ``failure`` or ``note``. units: (unit, status); candidates: (name, risk).

    A missing part (null) isn't checked, but a surface without rows and no units at all are failures.
    """
    graded = F.lit(False)
    for level in severity.LEVELS:
        graded = graded | F.contains(F.upper(F.coalesce("risk", F.lit(""))), F.lit(level))
    one = units.sparkSession.range(1)
    check = lambda name, n, level="failure": (F.lit(name).alias("check"), F.lit(level).alias("level"), n.cast("long").alias("n"))
    rows = [
        one.select(*check("surface enumerated", F.lit(int(not n_surface)))),
        units.agg((F.count("*") == 0).cast("int").alias("n")).select(*check("units exist", F.col("n"))),
        units.agg(F.count_if(folded(F.col("status")) != "reviewed").alias("n")).select(*check("units reviewed", F.col("n"))),
        candidates.agg(F.count_if(~graded).alias("n")).select(*check("candidates graded", F.col("n"))),
    ]
    if converged is not None:
        rows.append(one.select(*check("run converged", F.lit(int(not converged)))))
    if unowned_files is not None:
        rows.append(unowned_files.agg(F.count("*").alias("n")).select(*check("inventory owned", F.col("n"), "failure" if strict else "note")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def passed(checks: DataFrame) -> DataFrame:
    """One row: whether no check of level failure is broken."""
    return checks.agg((F.count_if((F.col("level") == "failure") & (F.col("n") > 0)) == 0).alias("passed"))


def reconcile(worklist: DataFrame, units: DataFrame) -> DataFrame:
    """(slug, status, change) of a worklist (slug, status) against the units (slug) there are: added as open, kept as it was, or stale."""
    rows = worklist.join(units.select("slug", F.lit(True).alias("_there")).distinct(), "slug", "full")
    change = F.when(F.col("_there").isNull(), "stale").when(F.col("status").isNull(), "added").otherwise("kept")
    return rows.select("slug", F.coalesce("status", F.lit("open")).alias("status"), change.alias("change"))


def mark_reviewed(worklist: DataFrame, clean: DataFrame) -> DataFrame:
    """The worklist with open slugs that were reviewed cleanly as reviewed."""
    done = clean.select("slug", F.lit(True).alias("_clean")).distinct()
    status = F.when(F.col("_clean") & (F.col("status") == "open"), "reviewed").otherwise(F.col("status"))
    return worklist.join(done, "slug", "left").select("slug", status.alias("status"))


def prior_runs(workspaces: DataFrame, worklists: DataFrame, outputs: DataFrame) -> DataFrame:
    """(workspace, prior): whether a run has left something there: a row of output, or a reviewed unit. Seeded units only don't count.

    workspaces: (workspace); worklists: (workspace, status); outputs: (workspace), a row for each candidate, finding or proof.
    """
    reviewed = worklists.where("status = 'reviewed'").select("workspace")
    left = reviewed.unionByName(outputs.select("workspace")).distinct().withColumn("_left", F.lit(True))
    return workspaces.select("workspace").distinct().join(left, "workspace", "left").select("workspace", F.coalesce("_left", F.lit(False)).alias("prior"))
