"""Review of diffs: from text to kept and dropped findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import coerce
from siftstone.functions.category import normalized
from siftstone.operators import chunk, filters, select
from siftstone.operators.dedup import FINDING_KEY, first_wins
from siftstone.plans.seams import Provider, ask


def batches(diffs: DataFrame, rules: Mapping[str, Sequence[str]], cap: int = chunk.BATCH) -> DataFrame:
    """(diff_id, batch, n_batches, text): a diff's files without noise, packed in order. A diff of noise alone has no row, and needs no review."""
    kept, _ = filters.strip_noise(chunk.split_diff(diffs.select("diff_id", "diff")), rules)
    sized = kept.select("diff_id", F.col("chunk_no").cast("long").alias("seq"), F.length("chunk").cast("long").alias("size"), "chunk")
    packed = sized.join(chunk.pack(sized, "diff_id", "seq", "size", cap), ["diff_id", "seq"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "")
    whole = packed.groupBy("diff_id", "batch").agg(text.alias("text"))
    return whole.withColumn("n_batches", F.count("*").over(Window.partitionBy("diff_id")))


def findings_of(replies: DataFrame) -> DataFrame:
    """Findings of replies (diff_id, batch, n_batches, reply), with seq in reply order."""
    rows = replies.select("diff_id", "batch", "n_batches", F.posexplode(coerce.findings(F.col("reply"))).alias("n", "x"))
    return rows.select("diff_id", "n_batches", (F.col("batch") * 1_000_000 + F.col("n")).cast("long").alias("seq"), "x.*")


def finish(findings: DataFrame, known: DataFrame, rules: Mapping[str, Sequence[str]], excluded: Sequence[str] = (), floor: float = filters.FLOOR) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped). Findings of a diff in several batches are deduplicated, those of one batch are not; then categories are normalized.

    The order matters: rows that only normalization makes equal stay.
    """
    one = F.when(F.col("n_batches") == 1, F.col("seq"))
    unique = first_wins(findings, [F.col("diff_id"), *(F.col(c) for c in FINDING_KEY), one])
    return filters.filter_findings(normalized(unique, "category", known), rules, excluded, floor)


def review(diffs: DataFrame, provider: Provider, known: DataFrame, triggers: DataFrame, vulns: DataFrame, rules: Mapping[str, Sequence[str]], excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, failed) for diffs (diff_id, diff): failed are the diffs of which a batch had no usable reply."""
    parts = batches(diffs, rules)
    hits = select.triggered(diffs.select("diff_id", F.col("diff").alias("text")), triggers)
    classes = select.top_classes(hits, vulns).groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "vuln_id"))), lambda x: x["vuln_id"]), ", ").alias("classes"))
    prompt = F.concat(F.lit("Classes: "), F.coalesce("classes", F.lit("all")), F.lit("\n\n"), F.col("text"))
    replies = ask(parts.join(classes, "diff_id", "left").select("diff_id", "batch", "n_batches", prompt.alias("prompt")), provider)
    usable = F.col("ok") & coerce.findings(F.col("reply")).isNotNull()
    kept, dropped = finish(findings_of(replies.where(usable)), known, rules, excluded)
    return kept, dropped, replies.where(~usable).select("diff_id").distinct()
