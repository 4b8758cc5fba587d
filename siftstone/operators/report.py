"""Reports of findings: order, counts, and text, markdown, JSON and SARIF renderings.

A rendering is one document: the findings of one report are gathered into one value on an executor. ``by`` names the
columns that tell reports apart (a target, a run), so any number of reports is rendered at once, each where its rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.functions.location import at_line, finding_slug
from siftstone.operators.order import numbered
from siftstone.operators.union import consensus

TOOL = "siftstone"
FIELDS = ("file", "line", "severity", "category", "description", "exploit_scenario", "recommendation", "confidence")


def report_order() -> list[Column]:
    return [severity.index(severity.normalize(F.col("severity"))), F.col("file"), F.coalesce("line", F.lit(0)), F.col("seq")]


def _sorted(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows by the keys, each worked out once a row and not in every comparison."""
    names = [f"_key{i}" for i in range(len(keys))]
    return rows.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True))).orderBy(*names).drop(*names)


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By severity from the worst, file, line and seq."""
    return _sorted(findings, *report_order())


def ranked(findings: DataFrame) -> DataFrame:
    """By consensus, then severity from the worst (unknown ones last), then seq."""
    return _sorted(findings, *rank_order())


def rank_order() -> list[Column]:
    return [-F.coalesce(consensus(F.col("found_by")), F.lit(-1)), severity.index(F.col("severity"), unknown=len(severity.LEVELS)), F.col("seq")]


def severity_counts(findings: DataFrame, level: Column | None = None) -> DataFrame:
    """(severity, n) for all four levels, from the worst."""
    value = severity.normalize(F.col("severity")) if level is None else level
    counts = findings.groupBy(value.alias("severity")).agg(F.count("*").alias("n"))
    levels = findings.sparkSession.createDataFrame([(x,) for x in severity.LEVELS], "severity string")
    return levels.join(counts, "severity", "left").fillna(0, ["n"])


def _rows(findings: DataFrame, by: Sequence[str], *shown: Column) -> DataFrame:
    """One row a report: ``xs``, its findings in report order with their shown columns. Without ``by`` there is one, empty or not."""
    order = [c.alias(f"_{i}") for i, c in enumerate(report_order())]
    xs = F.array_sort(F.collect_list(F.struct(*order, F.struct(*shown).alias("x"))))
    return findings.groupBy(*by).agg(F.transform(xs, lambda r: r["x"]).alias("xs"))


def _counts(xs: Column) -> Column:
    """``1 CRITICAL, 2 HIGH ...`` without zeros."""
    n = lambda level: F.size(F.filter(xs, lambda x: x["severity"] == level))
    return F.concat_ws(", ", *(F.when(n(level) > 0, F.concat_ws(" ", n(level).cast("string"), F.lit(level))) for level in severity.LEVELS))


def as_text(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a report: a line for each finding, its description below."""
    place = at_line(F.col("file"), F.col("line"))
    line = F.concat(F.lit("["), "severity", F.lit("] "), place, F.lit(" "), "category", F.lit("\n  "), "description")
    return _rows(findings, by, line.alias("line")).select(*by, F.when(F.size("xs") == 0, "no findings").otherwise(F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("report"))


def as_markdown(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a report: a header with counts, then a section for each finding."""
    title = F.concat(F.lit("## "), "severity", F.lit(": "), "category", F.lit(" at `"), at_line(F.col("file"), F.col("line")), F.lit("`"))
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), c))
    section = F.concat_ws("\n\n", title, F.nullif("description", F.lit("")), part("Scenario", "exploit_scenario"), part("Fix", "recommendation"))
    rows = _rows(findings, by, F.col("severity"), section.alias("section"))
    head = F.concat(F.lit("# Review: "), F.size("xs").cast("string"), F.lit(" findings"), F.when(F.size("xs") > 0, F.concat(F.lit(" ("), _counts(F.col("xs")), F.lit(")"))).otherwise(""))
    return rows.select(*by, F.concat_ws("\n\n", head, F.array_join(F.transform("xs", lambda x: x["section"]), "\n\n")).alias("report"))


def targets(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, target): a report's provenance as a map, fields by name; fields: (by, field, value), a handful for each report."""
    return fields.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("target"))


def _with_target(rows: DataFrame, by: Sequence[str], fields: DataFrame | None) -> DataFrame:
    """rows, one a report, with their target; null without provenance."""
    if fields is None:
        return rows
    known = targets(fields, by).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(known, [*by, "_one"], "left").withColumn("target", F.when(F.size("target") > 0, F.col("target"))).drop("_one")


def with_target_text(reports: DataFrame, kind: str, by: Sequence[str], fields: DataFrame) -> DataFrame:
    """Text or markdown reports with a line for each field before them, where there is provenance."""
    lines = F.array_join(F.transform(F.map_entries("target"), lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), x["value"])), "\n")
    head = F.lit("Target:\n" if kind == "text" else "## Target\n\n")
    shown = F.when(F.col("target").isNotNull(), F.concat(head, lines, F.lit("\n\n"), "report")).otherwise(F.col("report"))
    return _with_target(reports, by, fields).select(*by, shown.alias("report"))


def as_json(findings: DataFrame, by: Sequence[str] = (), target: DataFrame | None = None) -> DataFrame:
    """One row a report: ``{"findings": [...], "summary": {level: n}}``, and ``"target": {field: value}`` where provenance is given."""
    rows = _with_target(_rows(findings, by, *(F.col(c) for c in FIELDS)), by, target)
    added = [] if target is None else [F.col("target")]
    count = lambda level: F.size(F.filter("xs", lambda x: x["severity"] == level)).alias(level)
    return rows.select(*by, F.to_json(F.struct(F.col("xs").alias("findings"), F.struct(*map(count, severity.LEVELS)).alias("summary"), *added), {"ignoreNullFields": "false"}).alias("report"))


def sarif_rules(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rule_id, rule_index): categories of findings with a file, numbered by first appearance in report order. One row a rule."""
    placed = findings.where("file <> ''").withColumn("rule_id", F.when(F.coalesce("category", F.lit("")) == "", "security").otherwise(F.col("category")))
    first = placed.groupBy(*by, "rule_id").agg(F.min(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(report_order())))).alias("first"))
    return first.select(*by, "rule_id", (F.row_number().over(Window.partitionBy(*by).orderBy("first")) - 1).alias("rule_index"))


def as_sarif(findings: DataFrame, by: Sequence[str] = (), target: DataFrame | None = None) -> DataFrame:
    """One row a report: a SARIF 2.1.0 log; provenance is among its run's properties."""
    placed = findings.where("file <> ''").withColumn("rule_id", F.when(F.coalesce("category", F.lit("")) == "", "security").otherwise(F.col("category")))
    rules = sarif_rules(findings, by)
    region = F.when(F.coalesce("line", F.lit(0)) > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.coalesce(F.nullif("description", F.lit("")), F.nullif("category", F.lit("")), F.lit("security finding"))
    result = (F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), severity.sarif_level(F.col("severity")).alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), F.struct("severity", "category", "confidence", F.col("exploit_scenario").alias("exploitScenario")).alias("properties"))
    results = _rows(placed.join(rules, [*by, "rule_id"]), by, *result)
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.col("rule_id").alias("text")).alias("shortDescription"))
    named = rules.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", rule.alias("r")))), lambda x: x["r"]).alias("rules"))
    driver = F.struct(F.struct(F.lit(TOOL).alias("name"), F.col("rules")).alias("driver"))
    properties = [] if target is None else [F.when(F.col("target").isNotNull(), F.struct("target")).alias("properties")]
    run = F.struct(driver.alias("tool"), F.col("xs").alias("results"), *properties)
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    # without by, two single rows meet on a constant
    both = results.withColumn("_one", F.lit(1)).join(named.withColumn("_one", F.lit(1)), [*by, "_one"])
    return _with_target(both.drop("_one"), by, target).select(*by, F.to_json(log).alias("report"))


FORMATS = {"text": as_text, "markdown": as_markdown, "json": as_json, "sarif": as_sarif}


def render(findings: DataFrame, kind: str, by: Sequence[str] = (), target: DataFrame | None = None) -> DataFrame:
    """One row a report, in a format; target: its provenance (by, field, value)."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(FORMATS)}")
    if target is None:
        return FORMATS[kind](findings, by)
    if kind in ("json", "sarif"):
        return FORMATS[kind](findings, by, target)
    return with_target_text(FORMATS[kind](findings, by), kind, by, target)


def finding_names(findings: DataFrame, stem: Column | None = None) -> DataFrame:
    """findings with ``name``: the candidate's stem or a slug of place and category; later ones of a name get -2, -3 ... by rank.

    A suffixed name that is another's own name gets a further hyphen and its seq, so names stay unique.
    """
    slug = finding_slug(F.concat_ws("-", at_line(F.col("file"), F.col("line")), "category"))
    based = findings.withColumn("_base", slug if stem is None else F.coalesce(F.nullif(stem, F.lit("")), slug))
    keyed = based.withColumns({f"_key{i}": k for i, k in enumerate(rank_order())})
    # by key ranges: a popular name is no task's alone
    placed = numbered(keyed, ["_base"], ["_key0", "_key1", "_key2"], "_place").drop("_key0", "_key1", "_key2")
    named = placed.withColumn("_n", (F.col("_place") + 1).cast("int")).drop("_place").withColumn("name", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string"))))
    again = F.row_number().over(Window.partitionBy("name").orderBy("_n", "seq"))
    return named.withColumn("_again", again).withColumn("name", F.when(F.col("_again") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("seq").cast("string")))).drop("_base", "_n", "_again")


def finding_notes(findings: DataFrame) -> DataFrame:
    """(name, note): a markdown note for each named finding; evidence with headings of its own stays as it is."""
    head = F.concat(F.lit("# "), "title", F.lit("\n\n- Risk: "), "severity", F.lit("\n- Location: `"), at_line(F.col("file"), F.col("line")), F.lit("`\n- Class: "), "category", F.lit("\n- Endpoint: "), "endpoint")
    body = F.when(F.startswith("evidence", F.lit("#")), F.col("evidence")).otherwise(F.concat(F.lit("## Evidence\n\n"), "evidence"))
    return findings.select("name", F.concat_ws("\n\n", head, body).alias("note"))


def surface_rows(units: DataFrame, failed: DataFrame) -> DataFrame:
    """(unit, status): reviewed, or open where the unit failed."""
    bad = failed.select("unit", F.lit(True).alias("_bad")).distinct()
    return units.join(bad, "unit", "left").select("unit", F.when(F.col("_bad"), "open").otherwise("reviewed").alias("status"))


def poc_gaps(findings: DataFrame, pocs: DataFrame) -> DataFrame:
    """(name, gap): findings without a proof and proofs (stem) without a finding."""
    a, b = findings.select("name").distinct(), pocs.select(F.col("stem").alias("name")).distinct()
    return a.join(b, "name", "left_anti").select("name", F.lit("no proof").alias("gap")).unionByName(b.join(a, "name", "left_anti").select("name", F.lit("no finding").alias("gap")))


def poc_for(findings: DataFrame, pocs: DataFrame) -> DataFrame:
    """(name, poc): the first proof file whose name is the finding's, or begins with it and a dot. They meet by the part before a dot."""
    parts = pocs.select("file", F.explode(F.array_distinct(F.concat(F.array("file"), F.transform(F.sequence(F.lit(1), F.size(F.split("file", r"\."))), lambda i: F.array_join(F.slice(F.split("file", r"\."), F.lit(1), i), "."))))).alias("name"))
    return findings.select("name").distinct().join(parts, "name", "left").groupBy("name").agg(F.min("file").alias("poc"))


def finding_entries(findings: DataFrame, pocs: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Findings as stored entries: their fields, how many models found each, its proof, and the owner of its line if known.

    owners: (file, line, owner), from a version history.
    """
    proofs = poc_for(findings, pocs)
    rows = findings.join(proofs, "name", "left").withColumn("models", consensus(F.col("found_by")))
    if owners is not None:
        rows = rows.join(owners.select("file", "line", "owner"), ["file", "line"], "left")
    else:
        rows = rows.withColumn("owner", F.lit(None).cast("string"))
    return rows.select("name", "title", "category", "severity", "file", "line", "endpoint", "symbol", "evidence", "status", "source", "models", "found_by", "poc", "owner")


def refuted_list(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, place, category, reason) of findings that verification refuted."""
    return findings.join(verdicts.where("not real").select("key", "reason"), "key").select("key", at_line(F.col("file"), F.col("line")).alias("place"), "category", "reason")


def shown(items: Column, most: int) -> Column:
    """The first of a list of texts, with an ellipsis if there are more."""
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(head, F.lit(" ..."))).otherwise(head)


def result_json(outcomes: DataFrame) -> DataFrame:
    """(target, report) of outcomes (target, id, outcome): found, missed, false positives, extra, recall and precision as JSON."""
    ids = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("id")))).alias(o)
    rows = outcomes.groupBy("target").agg(ids("found"), ids("missed"), ids("false_positive"), ids("extra"))
    planted, known = F.size("found") + F.size("missed"), F.size("found") + F.size("false_positive")
    rate = lambda of: F.when(of > 0, F.bround(F.size("found") / of, 4)).otherwise(1.0)
    return rows.select("target", F.to_json(F.struct("target", "found", "missed", F.col("false_positive").alias("false_positives"), "extra", rate(planted).alias("recall"), rate(known).alias("precision_known"))).alias("report"))


def flips_text(flips: DataFrame) -> DataFrame:
    """One row: a line for each kind of flip with its ids."""
    rows = flips.groupBy("flip").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    line = F.concat("flip", F.lit(": "), shown(F.col("ids"), 8))
    return rows.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("report"))
