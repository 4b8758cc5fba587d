"""Queries on reviews as a whole: votes, routes, notes, prompts, runs with canned models, gates and their texts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import location
from siftstone.functions.text import basename
from siftstone.operators import callgraph, chunk, compare, coverage, report, score, select, union, verify, workspace
from siftstone.plans import adversarial, evaluate, review_diff, review_repository, seams
from siftstone.queries import findings as f
from siftstone.queries import knowledge as k
from siftstone.queries import paths, scoring, text
from siftstone.queries.adapters import cte, relation
from siftstone.session import shared_folder
from siftstone.sources.rules import DEFAULT


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "files")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def unreviewed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select(F.col("path").alias("key"))
    return verify.open_items(rows, rows.where("key like '%.go'"))


def resumed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select(F.col("path").alias("unit"))
    return review_repository.resumed(rows, rows.where("unit like '%/de/%'"), rows)


def fragment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("unit"), "path")
    units = rows.groupBy("unit").agg(F.collect_list(F.struct(F.col("path").alias("file"))).alias("fragments"))
    return chunk.without_test_fragments(units, F.contains("file", F.lit("/tests/")) & F.col("file").like("%.go")).select("unit")


def control_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" `"), path, F.lit(":12` "))).when(F.col("doc_id") % 3 == 1, F.concat(basename(path), F.lit(":3"))).otherwise(F.concat(F.lit("x/"), basename(path)))
    rows = _files(spark, sf_dir).select("doc_id", "path", location.control_ref(ref).alias("ref"))
    return rows.select("doc_id", "ref", location.on_file(F.col("ref"), path).alias("same"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    said = lambda c: c.cast("string")
    controls = F.when(n % 4 == 0, F.array(F.concat(F.lit("src/f"), said(n % 10), F.lit(".py:3")))).when(n % 4 == 1, F.array(F.concat(F.lit("f"), said(n % 10), F.lit(".py")))).when(n % 4 == 2, F.array(F.lit(" ")))
    return _orders(spark, sf_dir).select(n.alias("key"), (F.col("o_orderstatus") != "P").alias("parsed"), F.when(n % 7 != 0, n % 3 == 0).alias("real"), controls.alias("controls"), F.array(F.concat(F.lit("src/f"), said(n % 5), F.lit(".py"))).alias("shown"), F.when(n % 5 == 0, " ").otherwise("x").alias("code"))


def skeptic_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("key", verify.skeptic_verdict(F.col("parsed"), F.col("real"), F.col("controls"), F.col("shown")).alias("stays"))


def agent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("key", verify.agent_verdict(F.col("parsed"), F.col("real")).alias("stays"))


def confirmer_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("key", verify.confirmer_holds(F.col("parsed"), F.col("real"), F.col("code")).alias("holds"))


def resume_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f._candidates(spark, sf_dir).select("seq", union.resume_key(F.col("file"), F.col("line"), F.nullif("symbol", F.lit(""))).alias("key"))


def reloaded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f._candidates(spark, sf_dir).select("seq", F.when(F.col("line") > 50, "").when(F.col("line") > 25, F.lit(None)).otherwise(F.col("severity")).alias("severity"))
    return union.reloaded(rows)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.finding_names(union.fold(f._candidates(spark, sf_dir)))


def finding_note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f._candidates(spark, sf_dir)
    return report.finding_notes(rows.withColumn("name", F.col("seq").cast("string")).withColumn("evidence", F.when(F.col("line") > 50, F.concat(F.lit("# own\n"), "evidence")).otherwise(F.col("evidence"))))


def finding_entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    pocs = rows.where("line > 50").select(F.concat("name", F.when(F.col("line") > 75, ".t.sol").otherwise("")).alias("file"))
    owners = spark.createDataFrame([("src/view.py", i, f"dev{i % 3}") for i in range(0, 100, 2)], "file string, line int, owner string")
    out = report.finding_entries(rows, pocs, owners)
    return out.select("name", "title", "severity", "file", "line", "models", F.array_join("found_by", ",").alias("found_by"), "poc", "owner")


def refuted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("file"), (F.col("o_custkey") % 3).cast("int").alias("line"), F.col("o_orderpriority").alias("category"))
    return report.refuted_list(rows, f._verdicts(spark, sf_dir))


def rendered_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "findings")
    out = [report.render(rows, kind, ["reviewer"]).select(F.lit(kind).alias("kind"), "reviewer", F.sha2("report", 256).alias("digest")) for kind in ("text", "markdown")]
    return out[0].unionByName(out[1])


def result_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.result_json(score.outcomes(scoring._reports(spark, sf_dir), scoring._key(spark, sf_dir)))
    size = lambda key: F.json_array_length(F.get_json_object("report", f"$.{key}")).alias(key)
    return rows.select("target", *map(size, ("found", "missed", "false_positives", "extra")), *(F.get_json_object("report", f"$.{c}").cast("double").alias(c) for c in ("recall", "precision_known")))


def flip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flips_text(compare.flips(*scoring._halves(spark, sf_dir)))


def compare_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = scoring._halves(spark, sf_dir)
    full = workspace.compare_text(before, after, "t")
    return full.unionByName(workspace.compare_text(after, after, "t")).select(F.sha2("text", 256).alias("digest"))


def gate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = scoring.regression_gate(spark, sf_dir)
    return workspace.gate_text(fails, "t").unionByName(workspace.gate_text(fails.limit(0), "t")).select(F.sha2("text", 256).alias("digest"))


def covered_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.covered(k.coverage_matrix(spark, sf_dir))


def ordered_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.in_order(k.coverage_problems(spark, sf_dir))


def coverage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.coverage_text(covered_matrix(spark, sf_dir), k.coverage_problems(spark, sf_dir)).select(F.sha2("text", 256).alias("digest"))


def all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "items").select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit("b").alias("benchmark"), F.array("ref", F.concat(F.lit("guide:"), "tag")).alias("refs"))
    manifests = spark.createDataFrame([("b", ["vuln:brand-11", "vuln:nowhere"])], "id string, refs array<string>")
    return coverage.referenced(manifests, rows)


def fragment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    size = F.length("text")
    some = files.select(F.concat(F.lit("u"), (F.col("doc_id") % 40).cast("string")).alias("unit"), F.col("path").alias("file"), F.floor(size / 4).cast("int").alias("start"), F.floor(size / 2).cast("int").alias("end"))
    return chunk.gather_fragments(some, files.select("path", "text"), ["unit"]).select("unit", F.sha2("text", 256).alias("digest"))


def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _files(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.when(F.col("path").like("%.md"), "template").when(F.col("path").like("%.py"), " \n").otherwise(F.col("path")).alias("text"))
    return chunk.shared_context(parts, spark.createDataFrame([("template",)], "text string")).select(F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


def lens_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lens = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, " ").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    return parts.select("p_partkey", chunk.lens_header(lens).alias("header"))


def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.review_units(_files(spark, sf_dir).select("path", "text"), _files(spark, sf_dir).where("path like '%.go'").select("path"))
    return chunk.unit_docs(rows.where("window_no = 0").withColumn("unit", location.unit_slug(F.col("path")))).select("unit", F.sha2("doc", 256).alias("digest"))


def class_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = k.trigger_topk(spark, sf_dir)
    docs = k._vulns(spark).select("id", F.concat(F.lit("about "), "id").alias("body"))
    return select.bodies(chosen, docs)


def allowed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.allowed_categories(relation(spark, sf_dir, "items").select(F.col("ref").alias("id")))


def target_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = f._candidates(spark, sf_dir).select("seq", F.concat(F.lit("# T\n- Status: `"), F.upper("status"), F.lit("`\n- Risk: "), "severity", F.lit("\n")).alias("text"))
    return notes.select("seq", F.lower(location.field(F.col("text"), "status")).alias("status"), location.control_ref(location.field(F.col("text"), "risk")).alias("risk"), location.field(F.col("text"), "owner").alias("owner"))


class Reading:
    """A provider that answers from the prompt: a finding in the file that it names, nothing where it names none."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            found = re.search(r"file=(\S+) n=(\d+)", p)
            if found is None:
                out.append('{"findings": []}')
            elif int(found[2]) % 7 == 0:
                out.append(None)
            else:
                out.append(json.dumps({"findings": [{"title": "T", "file": found[1], "line": int(found[2]) % 5 + 1, "category": "sql-injection", "severity": "HIGH", "confidence": 0.9 if int(found[2]) % 2 else 0.2}]}))
        return out


class Steady(Reading):
    """A reviewer that finds nothing in what the other can't read."""

    def __call__(self, prompts):
        return [x or '{"findings": []}' for x in super().__call__(prompts)]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(F.col("path").alias("unit"), F.concat(F.lit("file="), "path", F.lit(" n="), F.col("doc_id").cast("string")).alias("prompt"), "doc_id")


def live_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that units which can't be read keep from converging: it ends after its last pass."""
    return _live(spark, sf_dir, Reading)


def live_run_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that converges: its first pass finds all, the next two are clean and add nothing."""
    return _live(spark, sf_dir, Steady)


def _live(spark: SparkSession, sf_dir: str, model: type) -> DataFrame:
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    found, state = review_repository.live(_asked(spark, sf_dir).select("unit", "prompt"), {"m1": model(), "m2": model()}, ["a", "b"], place, effort="low")
    return found.select("key", "file", "line", "severity", F.array_join("found_by", ",").alias("found_by"), "n_rows", F.lit(state["passes"]).alias("passes"), F.lit(state["converged"]).alias("converged"))


def reviewed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reviews = seams.reviewed(_asked(spark, sf_dir).select("unit", F.lit(1).alias("pass_no"), "prompt"), Reading())
    return reviews


def diff_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, dropped and failed of a diff for each file."""
    rows = _files(spark, sf_dir)
    diff = F.concat(F.lit("diff --git a/x b/"), "path", F.lit("\n--- a/x\n+++ b/"), "path", F.lit("\n+file="), "path", F.lit(" n="), F.col("doc_id").cast("string"), F.lit("\n"))
    known = spark.createDataFrame([("sql-injection", "high")], "id string, impact string")
    triggers = spark.createDataFrame([("sql-injection", "file=")], "vuln_id string, trigger string")
    kept, dropped, failed = review_diff.review(rows.select(F.col("doc_id").alias("diff_id"), diff.alias("diff")), Reading(), known, triggers, known, DEFAULT)
    shown = lambda df, what: df.select("diff_id", F.lit(what).alias("outcome"))
    return shown(kept, "kept").unionByName(shown(dropped, "dropped")).unionByName(shown(failed, "failed"))


class Seat:
    """A debate's seat by its part of the prompt: the finder reads, the challenger dismisses every third, the judge fails on every fifth."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __call__(self, prompts):
        out = []
        for p in prompts:
            n, path = int(re.search(r"n=(\d+)", p)[1]), re.search(r"file=(\S+)", p)[1]
            item = {"file": path, "line": 1, "category": "c", "severity": "LOW"}
            if self.name == "finder":
                out.append(json.dumps({"findings": [item], "echo": f"file={path} n={n}"}))
            elif self.name == "challenger":
                out.append(json.dumps({"dismissed": [path] if n % 3 == 0 else [], "findings": [item | {"line": 2}], "echo": f"file={path} n={n}"}))
            else:
                out.append("?" if n % 5 == 0 else json.dumps({"agreed": n % 2 == 0, "investigate": [], "findings": [item]}))
        return out


def adversarial_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    diffs = _files(spark, sf_dir).select(F.col("doc_id").alias("diff_id"), F.concat(F.lit("file="), "path", F.lit(" n="), F.col("doc_id").cast("string")).alias("text"))
    done = adversarial.rounds(diffs, Seat("finder"), Seat("challenger"), Seat("judge"), place)
    lines = done.findings.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("lines"))
    return done.status.join(lines, "diff_id", "left")


def retried_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that fails the first time: every reply is there the second time but those that always fail."""
    asked = _asked(spark, sf_dir).select("doc_id", "prompt")
    return seams.ask(asked, seams.Retrying(Reading(), retries=1, wait=0.0, deadline=60.0)).select("doc_id", "ok")


def finalized_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("sql-injection", "injection"), ("view", "injection"), ("click", "injection")], "alias string, id string")
    rows = review_repository.finalize(f._candidates(spark, sf_dir).withColumn("symbol", F.lit("")).withColumn("endpoint", F.lit("")), aliases)
    return rows.select("category", "file", "line", "seq", "n_rows")


def verified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of findings with and without a file, by their votes."""
    files = _files(spark, sf_dir).select("path")
    n = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select(n.cast("string").alias("key"), F.when(n % 4 == 0, "missing.py").otherwise(F.lit("a/b.py")).alias("file"), F.transform(F.sequence(F.lit(0), F.pmod(F.col("o_custkey"), F.lit(3)).cast("int")), lambda i: i.cast("string")).alias("found_by"))
    there = files.limit(0).unionByName(spark.createDataFrame([("a/b.py",)], "path string"))
    confirmed = _orders(spark, sf_dir).where("o_orderstatus <> 'P'").select(n.cast("string").alias("key"), F.lit("").alias("label"), (n % 7 != 0).alias("completed"), (n % 3 != 0).alias("holds"))
    return review_repository.verified(rows, there, relation(spark, sf_dir, "votes"), confirmed).select("key", "models", "step")


def seeded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_repository.seeded_units(_files(spark, sf_dir), DEFAULT, ["*.py"], [], [], ["*.go"])
    return rows.select("path", "window_no", F.size("files").alias("n_files"))


def evaluated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of reports against a key, folded: the second lacks the reports of one class."""
    reports, key = scoring._reports(spark, sf_dir), scoring._key(spark, sf_dir)
    done = evaluate.evaluate([reports, reports.where("category = 'injection'")], key, [0, 2])
    return done.summary.select("target", "reports", "errors", (F.col("n_found") + F.col("n_missed")).alias("planted"))


def call_path_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-path units under the operator's own cap."""
    functions = k._functions(spark, sf_dir)
    rows = callgraph.call_path_units(functions, k._calls(functions), F.col("external_call") & F.col("sends_eth"))
    return rows.select("contract", "anchor", F.size("fns").alias("n"), "chars")


QUERIES = {q.__name__: q for q in (unreviewed_units, resumed_units, fragment_units, control_files, skeptic_votes, agent_votes, confirmer_votes, resume_keys, reloaded_candidates, finding_note_rows, finding_entry_rows, refuted_rows, rendered_kinds, result_json_rows, flip_lines, compare_texts, gate_texts, covered_matrix, ordered_problems, coverage_texts, all_references, fragment_texts, context_text, lens_headers, unit_notes, class_bodies, allowed_classes, target_lines, live_run, live_run_converged, reviewed_units, diff_review, adversarial_rounds, retried_replies, finalized_union, verified_findings, seeded_units, evaluated_runs, call_path_sizes)}

_NL = "chr(10) || chr(10)"
_TEST = "contains(path, '/tests/')"
_NUM = "array_to_string(list_transform(range(1, len(string_split({0}, chr(10))) + 1), lambda i: lpad(CAST(i + {1} AS VARCHAR), CAST(length(CAST(len(string_split({0}, chr(10))) + {1} AS VARCHAR)) AS INT), ' ') || ' | ' || string_split({0}, chr(10))[i]), chr(10))"
_VOTES = "vt AS (SELECT o_orderkey AS n, o_orderstatus <> 'P' AS parsed, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS real FROM orders)"
_FLIP_IDS = "string_agg(id, ', ' ORDER BY id)"
_COVER = "CASE WHEN diff_positive + diff_safe + repository_planted + repository_safe = 0 THEN 'UNCOVERED' WHEN kind = 'vulnerability' AND repository_planted = 0 THEN 'REPOSITORY-UNCOVERED' ELSE '' END"
_ENTRIES = f"""{f._FOLDED}, b AS (SELECT *, {f._SLUGGED.format('(' + f._PLACE + ") || '-' || category")} AS base FROM (SELECT key, seq, title, file, line, severity, found_by, models, (SELECT category FROM candidates c WHERE c.seq = folded.seq) AS category FROM folded)),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY models DESC, {f._FINDINGS_ORDER}, seq) AS n FROM b), m AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS VARCHAR) END AS nm FROM r),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY nm ORDER BY n, seq) = 1 THEN nm ELSE nm || '-' || CAST(seq AS VARCHAR) END AS name FROM m)"""

SQL = {
    "unreviewed_units": f"WITH {cte('files')} SELECT path AS key FROM files WHERE path NOT LIKE '%.go'",
    "resumed_units": f"WITH {cte('files')} SELECT path AS unit FROM files WHERE path NOT LIKE '%/de/%'",
    "fragment_units": f"WITH {cte('files')} SELECT 'u' || CAST(doc_id % 50 AS VARCHAR) AS unit FROM files GROUP BY doc_id % 50 HAVING NOT bool_or({_TEST} AND path LIKE '%.go')",
    "control_files": f"WITH {cte('files')}, r AS (SELECT doc_id, path, list_last(string_split(path, '/')) AS name FROM files) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN name ELSE 'x/' || name END AS ref, doc_id % 3 <> 2 AS same FROM r",
    "skeptic_votes": f"WITH {_VOTES} SELECT n AS key, CASE WHEN parsed THEN coalesce(real, false) OR (n % 4 IN (0, 1) AND n % 10 <> n % 5) END AS stays FROM vt",
    "agent_votes": f"WITH {_VOTES} SELECT n AS key, CASE WHEN parsed THEN coalesce(real, false) END AS stays FROM vt",
    "confirmer_votes": f"WITH {_VOTES} SELECT n AS key, parsed AND coalesce(real, false) AND n % 5 <> 0 AS holds FROM vt",
    "resume_keys": f"WITH {cte('candidates')} SELECT seq, file || '|' || coalesce(CAST(line AS VARCHAR), 'None') || '|' || CASE WHEN symbol = '' THEN 'None' ELSE symbol END AS key FROM candidates",
    "reloaded_candidates": f"WITH {cte('candidates')} SELECT seq, CASE WHEN line > 25 THEN 'MEDIUM' ELSE severity END AS severity FROM candidates",
    "finding_note_rows": f"WITH {cte('candidates')} SELECT CAST(seq AS VARCHAR) AS name, '# ' || title || {_NL} || '- Risk: ' || severity || chr(10) || '- Location: `' || {f._PLACE} || '`' || chr(10) || '- Class: ' || category || chr(10) || '- Endpoint: ' || endpoint || {_NL} || CASE WHEN line > 50 THEN '# own' || chr(10) || evidence ELSE '## Evidence' || {_NL} || evidence END AS note FROM candidates",
    "finding_entry_rows": f"WITH {_ENTRIES} SELECT name, title, severity, file, line, models, found_by, CASE WHEN line > 75 THEN name || '.t.sol' WHEN line > 50 THEN name END AS poc, CASE WHEN file = 'src/view.py' AND line % 2 = 0 AND line < 100 THEN 'dev' || CAST(line % 3 AS VARCHAR) END AS owner FROM a",
    "refuted_rows": f"WITH {f._VERDICTS} SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE o_orderstatus || ':' || CAST(o_custkey % 3 AS VARCHAR) END AS place, o_orderpriority AS category, reason FROM orders JOIN verdicts ON key = CAST(o_orderkey AS VARCHAR) WHERE NOT real",
    "rendered_kinds": f"SELECT 'text' AS kind, reviewer, sha256(report) AS digest FROM ({f.SQL['report_text']}) UNION ALL SELECT 'markdown', reviewer, sha256(report) FROM ({f.SQL['report_markdown']})",
    "result_json_rows": scoring.SQL["score_summary"].replace("SELECT *, CASE", "SELECT target, CAST(found AS INT) AS found, CAST(missed AS INT) AS missed, CAST(false_positive AS INT) AS false_positives, CAST(extra AS INT) AS extra, CASE").replace(", missed = 0 AND false_positive = 0 AS clean FROM c", " FROM c"),
    "flip_lines": f"WITH {scoring._FLIPS}, ids AS (SELECT flip, list_sort(list(id)) AS xs FROM fl GROUP BY flip) SELECT string_agg(flip || ': ' || array_to_string(xs[1:8], ', ') || CASE WHEN len(xs) > 8 THEN ' ...' ELSE '' END, chr(10) ORDER BY flip) AS report FROM ids",
    "compare_texts": f"WITH {scoring._FLIPS}, ids AS (SELECT flip, {_FLIP_IDS} AS xs FROM fl GROUP BY flip) SELECT sha256('compare: t' || chr(10) || string_agg('  ' || replace(flip, '_', ' ') || ': ' || xs, chr(10) ORDER BY flip)) AS digest FROM ids UNION ALL SELECT sha256('compare: t' || chr(10) || '  no flips')",
    "gate_texts": f"WITH gt AS ({scoring.SQL['regression_gate']}) SELECT sha256('gate FAIL: t, ' || CAST(count(*) AS VARCHAR) || ' blocking' || chr(10) || string_agg('  - ' || rule || ': ' || detail, chr(10) ORDER BY rule, detail)) AS digest FROM gt UNION ALL SELECT sha256('gate PASS: t')",
    "covered_matrix": f"WITH {k._MATRIX} SELECT *, diff_positive > 0 AND diff_safe > 0 AS diff_covered, repository_planted > 0 AS repository_covered FROM mx",
    "ordered_problems": f"SELECT *, row_number() OVER (ORDER BY kind, ref, detail) - 1 AS place FROM ({k.SQL['coverage_problems']})",
    "coverage_texts": f"WITH {k._MATRIX}, pb AS ({k.SQL['coverage_problems']}), a AS (SELECT string_agg(rtrim(ref || ' ' || CAST(diff_positive AS VARCHAR) || ' ' || CAST(diff_safe AS VARCHAR) || ' ' || CAST(repository_planted AS VARCHAR) || ' ' || CAST(repository_safe AS VARCHAR) || ' ' || CASE WHEN public > 0 AND private > 0 THEN 'public/private' WHEN public > 0 THEN 'public' WHEN private > 0 THEN 'private' ELSE '-' END || ' ' || {_COVER}), chr(10) ORDER BY kind, ref) AS t FROM mx), b AS (SELECT string_agg(rtrim('[' || kind || '] ' || ref || ' ' || detail), chr(10) ORDER BY kind, ref, detail) AS t FROM pb) SELECT sha256('# Coverage' || chr(10) || a.t || {_NL} || '# Problems' || chr(10) || b.t) AS digest FROM a, b",
    "all_references": f"WITH {cte('items')} SELECT ref, 'entry b e' || CAST(id AS VARCHAR) AS origin FROM items UNION ALL SELECT 'guide:' || tag, 'entry b e' || CAST(id AS VARCHAR) FROM items UNION ALL SELECT 'vuln:brand-11', 'manifest b' UNION ALL SELECT 'vuln:nowhere', 'manifest b'",
    "fragment_texts": f"WITH {cte('files')}, c AS (SELECT 'u' || CAST(doc_id % 40 AS VARCHAR) AS unit, path, text, length(text) // 4 AS s, length(text) // 2 AS e FROM files), o AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY unit ORDER BY path, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, text[s + 1:e] AS t, len(string_split(text[1:s], chr(10))) - 1 AS skip FROM c) SELECT unit, sha256(string_agg('### ' || path || chr(10) || {_NUM.format('t', 'skip')}, {_NL} ORDER BY path, s)) AS digest FROM o WHERE before < 120000 GROUP BY unit",
    "context_text": f"WITH {cte('files')}, c AS (SELECT doc_id, path, coalesce(sum(least(length(path), 16000)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files WHERE path NOT LIKE '%.md' AND path NOT LIKE '%.py'), j AS (SELECT string_agg(path, {_NL} ORDER BY doc_id) AS t FROM c WHERE before < 16000), x AS (SELECT CASE WHEN length(t) > 16000 THEN t[1:16000] || chr(10) || '... truncated' ELSE t END AS t FROM j) SELECT sha256(t) AS digest, CAST(length(t) AS INT) AS n FROM x",
    "lens_headers": "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'Review for: ' || p_name || '.' ELSE 'Review for every class of defect.' END AS header FROM part",
    "unit_notes": f"""WITH wd AS (SELECT * FROM ({text.SQL['chunk_windows_full']}) WHERE window_no = 0), {cte('files')}, tg AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS n FROM files WHERE path LIKE '%.go'),
ot AS (SELECT wd.path, string_agg(tg.path, ', ' ORDER BY tg.path) AS others FROM wd JOIN tg ON tg.source = split_part(wd.path, '/', 1) AND tg.n <= 20 AND tg.path <> wd.path GROUP BY wd.path),
u AS (SELECT wd.*, others, {paths._SLUGGED.replace('(path,', '(wd.path,')} AS unit FROM wd LEFT JOIN ot ON ot.path = wd.path)
SELECT unit, sha256('# ' || unit || chr(10) || '- Status: open' || chr(10) || '- Entry: `' || path || '`, lines ' || CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) || chr(10) || '- Trace: ' || path || coalesce(', ' || others, '')) AS digest FROM u""",
    "class_bodies": f"WITH tk AS ({k.SQL['trigger_topk']}) SELECT diff_id, string_agg('about ' || vuln_id, {_NL} ORDER BY place) AS text FROM tk GROUP BY diff_id",
    "allowed_classes": f"WITH {cte('items')} SELECT DISTINCT ref AS id FROM items",
    "target_lines": f"WITH {cte('candidates')} SELECT seq, '`' || status || '`' AS status, severity AS risk, CAST(NULL AS VARCHAR) AS owner FROM candidates",
    "live_run": f"WITH {cte('files')} SELECT 'fl|' || lower(path) || '|sql-injection|' || CAST(doc_id % 5 + 1 AS VARCHAR) AS key, path AS file, CAST(doc_id % 5 + 1 AS INT) AS line, 'HIGH' AS severity, 'm1,m2' AS found_by, CAST(4 AS BIGINT) AS n_rows, 4 AS passes, false AS converged FROM files WHERE doc_id % 7 <> 0",
    "live_run_converged": f"WITH {cte('files')} SELECT 'fl|' || lower(path) || '|sql-injection|' || CAST(doc_id % 5 + 1 AS VARCHAR) AS key, path AS file, CAST(doc_id % 5 + 1 AS INT) AS line, 'HIGH' AS severity, 'm1,m2' AS found_by, CAST(3 AS BIGINT) AS n_rows, 3 AS passes, true AS converged FROM files WHERE doc_id % 7 <> 0",
    "reviewed_units": f"WITH {cte('files')} SELECT path AS unit, 1 AS pass_no, doc_id % 7 <> 0 AS ok FROM files",
    "diff_review": f"WITH {cte('files')} SELECT doc_id AS diff_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 2 = 1 THEN 'kept' ELSE 'dropped' END AS outcome FROM files WHERE NOT ({_TEST} OR contains(path, '/vendor/') OR path LIKE '%.md')",
    "adversarial_rounds": f"WITH {cte('files')} SELECT doc_id AS diff_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN 1 ELSE 2 END AS rounds, doc_id % 5 <> 0 AS converged, doc_id % 5 = 0 AS degraded, CASE WHEN doc_id % 5 <> 0 THEN '1' WHEN doc_id % 3 = 0 THEN '2' ELSE '1,2' END AS lines FROM files",
    "retried_replies": f"WITH {cte('files')} SELECT doc_id, doc_id % 7 <> 0 AS ok FROM files",
    "finalized_union": f"WITH {cte('candidates')}, c AS (SELECT *, CASE category WHEN 'SQL_Injection' THEN 'injection' WHEN 'view' THEN 'injection' WHEN 'click' THEN 'injection' WHEN 'missing auth' THEN 'missing-auth' ELSE category END AS cat FROM candidates) SELECT cat AS category, file, line, min(seq) AS seq, count(*) AS n_rows FROM c GROUP BY cat, file, line",
    "verified_findings": f"WITH {f._VERDICTS} SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey % 3 + 1 AS INT) AS models, CASE WHEN o_custkey % 3 + 1 >= 2 THEN 'consensus' WHEN o_orderkey % 4 = 0 THEN 'unlocatable' WHEN NOT coalesce(real, true) THEN 'refuted' WHEN coalesce(incomplete, true) THEN 'kept' ELSE 'verified' END AS step FROM orders LEFT JOIN verdicts ON verdicts.key = CAST(o_orderkey AS VARCHAR)",
    "seeded_units": f"SELECT path, window_no, CAST(len(string_split(files, ',')) AS INT) AS n_files FROM ({text.SQL['review_units'].replace("LIKE '%.py'", f"LIKE '%.py' AND NOT {_TEST}").replace("LIKE '%.go'", f"LIKE '%.go' AND NOT {_TEST}")})",
    "evaluated_runs": f"WITH {scoring._PAIRS} SELECT target, (SELECT count(*) FROM rp r WHERE r.target = k.target) + (SELECT count(*) FROM rp r WHERE r.target = k.target AND category = 'injection') AS reports, CAST(2 AS BIGINT) AS errors, count(*) AS planted FROM ky k WHERE kind = 'planted' GROUP BY target",
    "call_path_sizes": f"WITH RECURSIVE {k._UNITS.replace('2500', '16000')} SELECT contract, anchor, CAST(len(fs) AS INT) AS n, chars FROM un",
}
