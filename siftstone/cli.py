"""Command line: queries, reviews and evaluations as jobs.

    python -m siftstone.cli query NAME DATA_DIR [OUT]
    python -m siftstone.cli report FORMAT FINDINGS_PARQUET [--fail-on LEVEL]
    python -m siftstone.cli review diff [--file F | --git-range R] --provider MODULE:FUNCTION [--mode adversarial] [--format FORMAT] [--fail-on LEVEL]
    python -m siftstone.cli review repository DIR --workspace W (--scaffold | --run | --finalize | --gate)
    python -m siftstone.cli evals (list | score | diff | compare | gate | coverage) ...

A model is a function of a list of prompts to a list of replies, named by ``--provider``; ``--dry-run`` takes one that
finds nothing. Tables are Parquet folders, or JSON where the name ends so. Exit status: 0 clean, 1 findings at or above
``--fail-on``, failed units or a failed gate, 2 a wrong call.
"""

from __future__ import annotations

import argparse
import importlib
import json
import subprocess
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.functions.location import unit_slug
from siftstone.operators import chunk, compare, coverage, filters, gate, passes, report, score, union, workspace
from siftstone.plans import adversarial, review_diff, review_repository, seams
from siftstone.queries import queries
from siftstone.session import local_session, shared_folder, ship
from siftstone.sources import checkpoint, files, formats, keys, notes, payload, rules

CLASSES = "id string, impact string, triggers array<string>, aliases array<string>"
GLOBS, MARKERS, EXPORTS, LAYERS = ["*routes*", "*views*", "*controller*", "*handler*", "*main*"], ["@route", "@app.", "router.", "http.HandleFunc"], [r"^(export|public|def|func|function|contract)\b"], ["*/services/*", "*/service/*", "*/models/*", "*/lib/*"]


def provider(name: str | None, dry: bool) -> seams.Provider:
    if dry:
        return seams.Canned({})
    if not name or ":" not in name:
        raise ValueError("--provider MODULE:FUNCTION or --dry-run is needed")
    module, function = name.split(":", 1)
    return getattr(importlib.import_module(module), function)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.endswith(".json"):
        return (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return checkpoint.load(spark, path, schema)


def classes(spark: SparkSession, path: str | None) -> DataFrame:
    """The knowledge's classes: notes of a folder, or none."""
    if path is None:
        return spark.createDataFrame([], CLASSES)
    return notes.knowledge_docs(formats.read_notes(spark, path, "*.md")).select("id", "impact", "triggers", "aliases")


def shown(spark: SparkSession, findings: DataFrame, args: argparse.Namespace, failed: int = 0) -> int:
    """Print a report; 1 if a finding is as severe as --fail-on or a unit failed."""
    rows = findings.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in findings.columns else findings
    target = None
    if getattr(args, "source_meta", None):
        if not Path(args.source_meta).exists():
            raise ValueError(f"there is no {args.source_meta}")
        meta = payload.provenance(spark, args.source_meta)
        if meta is not None:
            fields = payload.provenance_rows(meta).select("field", "value")
            target = fields.unionByName(meta.where("address <> ''").select(F.lit("address").alias("field"), F.col("address").alias("value")))
    print(report.render(rows, args.format, target=target).first()["report"])
    if failed:
        print(f"{failed} units failed; this is no clean result", file=sys.stderr)
    return int(failed > 0 or filters.severity_gate(rows, args.fail_on).first()["failed"])


def diff_text(args: argparse.Namespace) -> str:
    if args.git_range:
        return subprocess.run(["git", "-C", args.repository or ".", "diff", args.git_range], check=True, capture_output=True, text=True).stdout
    return Path(args.file).read_text(encoding="utf-8") if args.file else sys.stdin.read()


def review_diff_(spark: SparkSession, args: argparse.Namespace) -> int:
    diffs = spark.createDataFrame([(0, diff_text(args))], "diff_id long, diff string")
    model, known = provider(args.provider, args.dry_run), classes(spark, args.knowledge)
    triggers = known.select(F.col("id").alias("vuln_id"), F.explode("triggers").alias("trigger"))
    if args.mode == "adversarial":
        place = args.workspace or f"{shared_folder(spark)}/debate-{uuid.uuid4().hex}"
        parts = review_diff.batches(diffs, rules.DEFAULT).select(F.col("batch").cast("long").alias("diff_id"), "text")
        seats = [provider(getattr(args, seat), False) if getattr(args, seat) else model for seat in chunk.SEATS]
        done = adversarial.rounds(parts, *seats, place, args.rounds)
        kept, dropped = filters.filter_findings(done.findings, rules.DEFAULT, args.exclude or [], 0.0 if args.no_filter else filters.FLOOR)
        failed = done.status.where("degraded").count()
    else:
        kept, dropped, bad = review_diff.review(diffs, model, known.select("id", "impact"), triggers, known.select("id", "impact"), rules.DEFAULT, args.exclude or [])
        failed = bad.count()
    if args.no_filter:
        kept = kept.unionByName(dropped.drop("reason"))
    return shown(spark, kept, args, failed)


def scaffold(spark: SparkSession, args: argparse.Namespace) -> int:
    """Detect the stack, make units and a worklist; what a workspace holds from a run stays unless --fresh."""
    place = args.workspace
    if args.fresh:
        print(f"cleared: {', '.join(checkpoint.clear(spark, place)) or 'nothing'}")
    elif checkpoint.has_prior_run(spark, place):
        print("the workspace holds an earlier run; --fresh clears it")
    checkpoint.mark(spark, place)
    tree = files.read_tree(spark, args.directory, rules.DEFAULT)
    checkpoint.save(tree, f"{place}/files")
    tree = checkpoint.load(spark, f"{place}/files")
    chosen = filters.domain(args.domain, tree.where(filters.is_source(F.col("path"), rules.DEFAULT)))
    units = review_repository.seeded_units(tree, rules.DEFAULT, GLOBS, MARKERS, EXPORTS, LAYERS, args.max_units)
    named = units.withColumn("unit", F.concat_ws("-", unit_slug(F.col("path")), F.col("window_no").cast("string")))
    checkpoint.save(named, f"{place}/units")
    named = checkpoint.load(spark, f"{place}/units")
    slugs = named.select(F.col("unit").alias("slug"))
    old = checkpoint.load(spark, f"{place}/worklist") if checkpoint.exists(spark, f"{place}/worklist") else slugs.limit(0).withColumn("status", F.lit("open"))
    work = gate.reconcile(old, slugs).where("change <> 'stale'").select("slug", "status")
    checkpoint.replace(work, f"{place}/worklist")
    notes_ = workspace.entrypoint_note(named.select("path").distinct(), tree.where(filters.is_logic_layer(F.col("path"), rules.DEFAULT, LAYERS)).select("path"))
    local = Path(place.removeprefix("file:"))
    (local / "inventory").mkdir(parents=True, exist_ok=True)
    (local / "inventory" / "entrypoints.md").write_text(notes_.first()["text"])
    kept = local / "inventory" / "invariants.md"
    text, said = workspace.imported_invariants(kept.read_text() if kept.exists() else None, "# Invariants\n", Path(args.invariants).read_text() if args.invariants else None)
    kept.write_text(text)
    print(f"domain {chosen}, {named.count()} units" + (f"; {said}" if said else ""))
    return 0


def prompted(spark: SparkSession, place: str) -> DataFrame:
    units, tree = checkpoint.load(spark, f"{place}/units"), checkpoint.load(spark, f"{place}/files")
    slices = units.select("unit", F.col("path").alias("file"), "start", "end")
    texts = chunk.gather_fragments(slices, tree, ["unit"])
    return texts.select("unit", F.concat(F.lit("Code:\n"), "text").alias("prompt"))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    place = args.workspace
    found, state = review_repository.live(prompted(spark, place), {"model": provider(args.provider, args.dry_run)}, args.lens or [""], f"{place}/passes", effort=args.effort, quiet=args.converge_after)
    checkpoint.save(found, f"{place}/union")
    reviews = spark.read.parquet(*(f"{place}/passes/pass-{i:04d}/reviews" for i in range(1, state["passes"] + 1)))
    clean = reviews.select("unit").distinct().join(passes.failed_units(reviews), "unit", "left_anti").select(F.col("unit").alias("slug"))
    work = gate.mark_reviewed(checkpoint.load(spark, f"{place}/worklist"), clean)
    checkpoint.replace(work, f"{place}/worklist")
    Path(place.removeprefix("file:"), "status.json").write_text(json.dumps(state))
    print(json.dumps(state))
    return int(state["errors"] > 0)


def finalize(spark: SparkSession, args: argparse.Namespace) -> int:
    place = args.workspace
    aliases = classes(spark, args.knowledge).select(F.explode("aliases").alias("alias"), "id")
    source = f"{place}/candidates" if checkpoint.exists(spark, f"{place}/candidates") else f"{place}/union"
    rows = checkpoint.load(spark, source)
    done = review_repository.finalize(rows.withColumn("pass_no", F.lit(1)) if "pass_no" not in rows.columns else rows, aliases)
    named = report.finding_names(done)
    checkpoint.save(named, f"{place}/findings")
    named = checkpoint.load(spark, f"{place}/findings")
    formats.write_tree(report.finding_notes(named).select(F.concat("name", F.lit(".md")).alias("path"), F.col("note").alias("text")), f"{place}/notes")
    as_findings = named.withColumns({"description": F.col("title"), "exploit_scenario": F.col("evidence"), "recommendation": F.lit(""), "confidence": F.lit(1.0)})
    return shown(spark, as_findings, args)


def check_gate(spark: SparkSession, args: argparse.Namespace) -> int:
    place = args.workspace
    work = checkpoint.load(spark, f"{place}/worklist").select(F.col("slug").alias("unit"), "status")
    found = checkpoint.load(spark, f"{place}/findings").select("name", F.col("severity").alias("risk")) if checkpoint.exists(spark, f"{place}/findings") else spark.createDataFrame([], "name string, risk string")
    status = Path(place.removeprefix("file:"), "status.json")
    converged = json.loads(status.read_text())["converged"] if status.exists() else None
    tree, units = checkpoint.load(spark, f"{place}/files"), checkpoint.load(spark, f"{place}/units")
    left = gate.unowned(tree.where(filters.in_inventory(F.col("path"), rules.DEFAULT)).select("path"), units.select(F.explode("files").alias("text")))
    checks = gate.completeness(work, found, units.count(), converged, left, args.strict_coverage)
    fails = checks.where("level = 'failure' and n > 0").select(F.col("check").alias("rule"), F.col("n").cast("string").alias("detail"))
    print(workspace.gate_text(fails, args.directory).first()["text"])
    return int(not gate.passed(checks).first()["passed"])


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """A result's (target, id, outcome) rows."""
    return table(spark, path, "target string, id string, outcome string")


def evals(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.what == "list":
        table(spark, args.benchmarks).select("id").orderBy("id").show(1000, truncate=False)
        return 0
    if args.what == "score":
        key = keys.answer_keys(spark.createDataFrame([(args.target, Path(args.key).read_text())], "target string, text string"))
        extensions = rules.DEFAULT["source_ext"]
        if args.findings_json:
            found = notes.findings_json(spark.createDataFrame([("r", Path(args.findings_json).read_text())], "name string, text string"), extensions)
        else:
            # a result's notes, a row a file
            found = notes.finding_notes(formats.read_notes(spark, args.findings_dir, "*.md"), extensions).withColumn("seq", F.row_number().over(Window.orderBy("name")))
        rows = score.outcomes(found.withColumn("target", F.lit(args.target)), key)
        if args.out:
            checkpoint.save(rows, args.out)
        print(report.result_json(rows).first()["report"])
        return int(not score.summary(rows).first()["clean"])
    if args.what == "diff":
        cases = keys.cases(spark.read.text(args.cases).select(F.col("value").alias("text")))
        if args.tag:
            cases = cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, args.tag))))
        diffs = cases.select(F.xxhash64("name").alias("diff_id"), "name", "diff", "category")
        known = classes(spark, args.knowledge)
        kept, _, failed = review_diff.review(diffs.select("diff_id", "diff"), provider(args.provider, args.dry_run), known.select("id", "impact"), known.select(F.col("id").alias("vuln_id"), F.explode("triggers").alias("trigger")), known.select("id", "impact"), rules.DEFAULT)
        audits = diffs.select("diff_id", "name").join(kept.groupBy("diff_id").agg(F.count("*").alias("n_kept")), "diff_id", "left").join(failed.withColumn("failed", F.lit(True)), "diff_id", "left").select("name", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("failed", F.lit(False)).alias("failed"), F.lit(False).alias("degraded"))
        result = score.diff_outcomes(cases, audits).select(F.lit("diff").alias("target"), F.col("name").alias("id"), "outcome")
        if args.out:
            checkpoint.save(result, args.out)
        counts = {r["outcome"]: r["count"] for r in result.groupBy("outcome").count().collect()}
        print(json.dumps(counts, sort_keys=True))
        return int(any(counts.get(k, 0) for k in ("missed", "false_positive", "error")))
    if args.what == "compare":
        before, after = outcomes(spark, args.before), outcomes(spark, args.after)
        if args.by:
            about = table(spark, args.attribution, "id string, refs array<string>, tags array<string>")
            for r in compare.flips_by_axis(compare.flips(before, after), about, args.by).orderBy("flip", "label", "id").toLocalIterator():
                print(f"{r['flip']} {r['label']}: {r['id']}")
        else:
            print(workspace.compare_text(before, after, "results").first()["text"])
        return 0
    if args.what == "gate":
        after = outcomes(spark, args.after)
        before = outcomes(spark, args.baseline) if args.baseline else None
        errors = after.where("outcome = 'error'").count()
        precision = score.summary(after).agg(F.min("precision_known").alias("p")).first()["p"]
        fails = compare.regression_gate(before, after, F.lit(errors), F.lit(1.0 if precision is None else precision), args.precision_floor)
        print(workspace.gate_text(fails, args.after).first()["text"])
        return int(not fails.isEmpty())
    items = keys.knowledge_items(table(spark, args.items, "ref string, kind string, path string"))
    cases, entries = table(spark, args.cases, "refs array<string>, positive boolean"), table(spark, args.entries, "id string, benchmark string, refs array<string>, planted boolean, provenance string")
    matrix = coverage.covered(coverage.matrix(items, coverage.uses(cases, entries)))
    refs = entries.select(F.explode("refs").alias("ref"), F.concat_ws(" ", F.lit("entry"), "benchmark", "id").alias("origin"))
    problems = coverage.problems(matrix, refs, entries)
    print(workspace.coverage_text(matrix, problems).first()["text"])
    return int(not problems.where("kind = 'unresolved-reference'").isEmpty())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftstone")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name")
    query.add_argument("data")
    query.add_argument("out", nargs="?")
    rendering = commands.add_parser("report", help="render findings; exit 1 if one is as severe as --fail-on")
    rendering.add_argument("format", choices=sorted(report.FORMATS))
    rendering.add_argument("findings")
    rendering.add_argument("--fail-on")
    review = commands.add_parser("review", help="review a diff or a repository").add_subparsers(dest="scope", required=True)
    diff, repository = review.add_parser("diff"), review.add_parser("repository")
    for p in (diff, repository):
        p.add_argument("--provider", help="MODULE:FUNCTION of prompts to replies")
        p.add_argument("--dry-run", action="store_true", help="a model that finds nothing")
        p.add_argument("--knowledge", help="a folder of class notes")
        p.add_argument("--format", choices=sorted(report.FORMATS), default="text")
        p.add_argument("--fail-on", choices=["critical", "high", "medium", "low"])
        p.add_argument("--source-meta", help="provenance JSON of the source")
        p.add_argument("--workspace", required=p is repository)
    diff.add_argument("--file")
    diff.add_argument("--git-range")
    diff.add_argument("--repository")
    diff.add_argument("--exclude", action="append")
    diff.add_argument("--no-filter", action="store_true")
    diff.add_argument("--mode", choices=["standard", "adversarial"], default="standard")
    diff.add_argument("--rounds", type=int, default=adversarial.ROUNDS)
    for seat in chunk.SEATS:
        diff.add_argument(f"--{seat}", metavar="MODULE:FUNCTION", help=f"the {seat}'s provider in a debate, in place of --provider")
    repository.add_argument("directory")
    mode = repository.add_mutually_exclusive_group(required=True)
    for name in ("scaffold", "run", "finalize", "gate"):
        mode.add_argument(f"--{name}", action="store_true")
    repository.add_argument("--fresh", action="store_true")
    repository.add_argument("--invariants")
    repository.add_argument("--domain", default="auto")
    repository.add_argument("--max-units", type=int)
    repository.add_argument("--effort", choices=sorted(review_repository.EFFORT), default="medium")
    repository.add_argument("--lens", action="append")
    repository.add_argument("--converge-after", type=int, default=passes.QUIET)
    repository.add_argument("--strict-coverage", action="store_true")
    ev = commands.add_parser("evals", help="measure reviews").add_subparsers(dest="what", required=True)
    ev.add_parser("list").add_argument("benchmarks")
    scoring = ev.add_parser("score")
    scoring.add_argument("target")
    scoring.add_argument("--key", required=True)
    group = scoring.add_mutually_exclusive_group(required=True)
    group.add_argument("--findings-dir")
    group.add_argument("--findings-json")
    probe = ev.add_parser("diff")
    probe.add_argument("cases", help="JSON lines")
    probe.add_argument("--tag", action="append")
    probe.add_argument("--provider")
    probe.add_argument("--dry-run", action="store_true")
    probe.add_argument("--knowledge")
    for p in (scoring, probe):
        p.add_argument("--out", help="where the result is kept")
    both = ev.add_parser("compare")
    both.add_argument("before")
    both.add_argument("after")
    both.add_argument("--by", choices=["vulnerability", "tag", *compare.AXES])
    both.add_argument("--attribution")
    gating = ev.add_parser("gate")
    gating.add_argument("after")
    gating.add_argument("--baseline")
    gating.add_argument("--precision-floor", type=float, default=0.0)
    cov = ev.add_parser("coverage")
    for name in ("items", "cases", "entries"):
        cov.add_argument(name)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    try:
        if args.command == "query":
            rows = queries()[args.name](spark, args.data)
            rows.write.mode("overwrite").parquet(args.out) if args.out else rows.show(20, truncate=80)
            return 0
        if args.command == "report":
            return shown(spark, spark.read.parquet(args.findings), args)
        if args.command == "evals":
            return evals(spark, args)
        if args.scope == "diff":
            return review_diff_(spark, args)
        steps = {"scaffold": scaffold, "run": run, "finalize": finalize, "gate": check_gate}
        return next(step for name, step in steps.items() if getattr(args, name))(spark, args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
