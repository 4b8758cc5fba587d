"""Splitting, packing and gathering of text under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import lines
from siftstone.functions.location import chunk_path
from siftstone.functions.text import strip
from siftstone.operators.order import within_total

BATCH, PER_FILE, TOTAL, UNIT = 60_000, 24_000, 120_000, 16_000


def split_diff(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """A row for each file of each diff (``chunk_no``, ``chunk``, ``path``); a diff without headers is one chunk unless it is blank."""
    pieces = F.filter(F.split(F.col(diff), "(?m)(?=^diff --git )"), lambda x: x != "")
    kept = F.when(strip(F.col(diff)) != "", pieces).otherwise(F.array().cast("array<string>"))
    rest = [c for c in diffs.columns if c != diff]
    return diffs.select(*rest, F.posexplode(kept).alias("chunk_no", "chunk")).withColumn("path", chunk_path(F.col("chunk")))


def pack(chunks: DataFrame, group: str, seq: str = "seq", size: str = "size", cap: int = BATCH) -> DataFrame:
    """chunks' (group, seq) with ``batch``: chunks in order, a new batch where the next would pass the cap; an oversize one is alone.

    The fold runs over (seq, size) pairs of one group, a diff; no text is in it, and what it gathers grows with the
    batches, not with the chunks.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["sum"] == 0) | (acc["sum"] + x["size"] <= cap)
        starts = F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"])))
        return F.struct(F.when(fits, acc["sum"] + x["size"]).otherwise(x["size"]).alias("sum"), (acc["at"] + 1).alias("at"), starts.alias("starts"))

    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).cast("bigint").alias("seq"), F.col(size).cast("bigint").alias("size"))))
    folded = chunks.groupBy(group).agg(ordered.alias("xs")).select(group, "xs", F.aggregate("xs", zero, step)["starts"].alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("xs"))
    batches = folded.select(group, F.posexplode(F.transform("starts", lambda at, i: F.slice("xs", at + 1, end(i) - at))).alias("batch", "part"))
    return batches.select(group, F.explode("part").alias("x"), "batch").select(group, F.col("x.seq").alias(seq), "batch")


def windowed(files: DataFrame, window: int = lines.WINDOW, overlap: int = lines.OVERLAP) -> DataFrame:
    """(path, window_no, start, end, first, last): spans that cover each text, and their lines; built-in expressions, a row at a time."""
    starts = F.when(F.length("text") > window, lines.boundaries(F.col("text"))).otherwise(F.array().cast("array<int>"))
    spans = files.select("path", "text", F.posexplode(lines.windows(F.length("text"), starts, window, overlap)).alias("window_no", "span"))
    at = lines.span_lines(F.col("text"), F.col("span.start"), F.col("span.end"))
    return spans.select("path", "window_no", "span.start", "span.end", at["first"].alias("first"), at["last"].alias("last"))


def within_budget(parts: DataFrame, group: list[str], order: list[str], size: str, total: int = TOTAL, per_part: int = PER_FILE) -> DataFrame:
    """Parts in order until their sizes, each cut to per_part, reach the total; the one that crosses it stays. ``taken``: its cut size.

    Sizes are summed by key ranges (``siftstone.operators.order``) without what else the parts have, so no task holds a
    group or its texts. Parts alike in group, order and size stay or go together.
    """
    cut = parts.withColumn("taken", F.least(F.col(size), F.lit(per_part)))
    return within_total(cut, group, order, "taken", total)


def gathered(parts: DataFrame, group: list[str], order: list[str], text: str = "text", total: int = TOTAL, per_part: int = PER_FILE) -> DataFrame:
    """One text a group: numbered lines of its parts within the budget, each after its path. Bounded by the budget."""
    kept = within_budget(parts.withColumn("_size", F.length(text)), group, order, "_size", total, per_part)
    block = F.concat(F.lit("### "), F.col("path"), F.lit("\n"), lines.numbered(F.left(text, F.col("taken"))))
    return kept.select(*group, F.struct(*order, block.alias("block")).alias("x")).groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["block"]), "\n\n").alias("text"))


def capped_text(blocks: DataFrame, group: list[str], order: list[str], block: str = "block", cap: int = UNIT, marker: str = "\n... truncated") -> DataFrame:
    """One text a group: its different blocks in order, cut at the cap and marked if it was cut."""
    first = blocks.groupBy(*group, block).agg(*(F.min(c).alias(c) for c in order))
    kept = within_budget(first.withColumn("_size", F.length(block)), group, [*order, block], "_size", cap, cap)
    joined = kept.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, block))), lambda x: x[block]), "\n\n").alias("_text"))
    text = F.when(F.length("_text") > cap, F.concat(F.left("_text", F.lit(cap)), F.lit(marker))).otherwise(F.col("_text"))
    return joined.select(*group, text.alias("text"))


def review_units(entrypoints: DataFrame, trace_targets: DataFrame, window: int = lines.WINDOW, overlap: int = lines.OVERLAP, most: int = 20) -> DataFrame:
    """A unit for each window of each entry point, with the first logic files below the same top directory.

    entrypoints: (path, text); trace_targets: (path). A target list is cut to its first paths before it is gathered.
    """
    top = lambda c: F.substring_index(c, "/", 1)
    order = Window.partitionBy("top").orderBy("path")
    targets = trace_targets.select(top(F.col("path")).alias("top"), "path").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = targets.groupBy("top").agg(F.array_sort(F.collect_list("path")).alias("targets"))
    units = windowed(entrypoints, window, overlap).withColumn("top", top(F.col("path")))
    files = F.concat(F.array("path"), F.coalesce(F.filter("targets", lambda t: t != F.col("path")), F.array().cast("array<string>")))
    return units.join(lists, "top", "left").select("path", "window_no", "start", "end", "first", "last", files.alias("files"))


def gather_fragments(fragments: DataFrame, files: DataFrame, group: list[str], total: int = TOTAL) -> DataFrame:
    """One text a group: source slices (file, start, end) by file and place, within the budget; numbered from their own first lines."""
    texts = files.select(F.col("path").alias("file"), "text")
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    block = F.concat(F.lit("### "), F.col("file"), F.lit("\n"), lines.numbered(part, lines.line_at(F.col("text"), F.col("start"))))
    sized = fragments.join(texts, "file").withColumn("_size", F.col("end") - F.col("start")).withColumn("block", block)
    kept = within_budget(sized, group, ["file", "start"], "_size", total, total)
    ordered = F.array_sort(F.collect_list(F.struct("file", "start", "block")))
    return kept.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("text"))


def without_test_fragments(units: DataFrame, is_test: Column) -> DataFrame:
    """Units (unit, fragments) none of whose fragments' files is a test's; is_test judges the column ``file``."""
    bad = units.select("unit", F.explode("fragments.file").alias("file")).where(is_test).select("unit").distinct()
    return units.join(bad, "unit", "left_anti")


def shared_context(parts: DataFrame, templates: DataFrame, cap: int = UNIT) -> DataFrame:
    """One row: workspace parts (seq, text) that were edited, that is, differ from every template (text), in order under the cap."""
    edited = parts.where(strip(F.col("text")) != "").join(templates.select(F.col("text")).distinct(), "text", "left_anti")
    rows = edited.withColumn("_all", F.lit(1))
    return capped_text(rows, ["_all"], ["seq"], "text", cap).select("text")


def lens_header(lens: Column) -> Column:
    """What a reviewer is told to look for; without a lens, everything."""
    return F.when(F.coalesce(strip(lens), F.lit("")) == "", "Review for every class of defect.").otherwise(F.concat(F.lit("Review for: "), strip(lens), F.lit(".")))


def review_prompt(text: Column, classes: Column | None = None, stack: Column | None = None, context: Column | None = None, categories: Column | None = None, rubric: Column | None = None) -> Column:
    """What a reviewer of a change is given: its parts in order, those that are there, each under its name."""
    part = lambda name, c: F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    parts = (("Categories, one for each finding", categories), ("Conventions", stack), ("Classes", classes), ("Change", text), ("Context, not under review", context), ("Severities", rubric))
    return F.concat_ws("\n\n", F.lit("Review this change for defects. Reply with JSON: a list ``findings``, empty if there is none."), *(part(n, c) for n, c in parts if c is not None))


#: What each seat of a debate is asked, by its name.
SEATS = {"finder": "Report each defect of the change with its file and line.", "challenger": "Refute what doesn't hold and report what was missed.", "judge": "Decide which findings stay, and say whether anything is left to investigate."}


def seat_prompt(seat: str, text: Column, *so_far: Column) -> Column:
    """What a seat of a debate is given: its task, the change, and what the seats before it said."""
    if seat not in SEATS:
        raise ValueError(f"unknown seat {seat}; there are {', '.join(SEATS)}")
    said = (F.when(F.coalesce(strip(c), F.lit("")) != "", F.concat(F.lit("So far:\n"), c)) for c in so_far)
    return F.concat_ws("\n\n", F.lit(SEATS[seat]), F.concat(F.lit("Change:\n"), text), *said)


def skeptic_prompt(finding: Column, code: Column) -> Column:
    """What a skeptic is given: the finding and the numbered code that it cites."""
    return F.concat_ws("\n\n", F.lit("Is this finding real? Reply with JSON: ``real``, ``reason`` and ``controls``, the files that prevent it."), F.concat(F.lit("Finding:\n"), finding), F.concat(F.lit("Code:\n"), lines.numbered(code)))


def unit_docs(units: DataFrame) -> DataFrame:
    """(unit, doc): a work note for each unit (unit, path, first, last, files)."""
    span = F.concat(F.lit("lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    return units.select("unit", F.concat_ws("\n", F.concat(F.lit("# "), "unit"), F.lit("- Status: open"), F.concat(F.lit("- Entry: `"), "path", F.lit("`, "), span), F.concat(F.lit("- Trace: "), F.array_join("files", ", "))).alias("doc"))
