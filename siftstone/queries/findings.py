"""Queries on findings and candidates: severities, keys, unions, passes, filters, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import category, severity
from siftstone.operators import dedup, filters, passes, report, union, verify
from siftstone.queries.adapters import cte, relation
from siftstone.sources.rules import DEFAULT

LEVELS = ", ".join(f"('{x}')" for x in severity.LEVELS)
ORDERS = "lv AS (SELECT o_custkey, o_orderkey, CASE WHEN contains(upper(o_orderpriority), 'CRITICAL') THEN 'CRITICAL' WHEN contains(upper(o_orderpriority), 'HIGH') THEN 'HIGH' WHEN contains(upper(o_orderpriority), 'MEDIUM') THEN 'MEDIUM' WHEN contains(upper(o_orderpriority), 'LOW') THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM orders)"
RANK = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
BY_RANK = "CASE {} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
FOLD = "lower(trim({}))"
SYMBOL = "regexp_replace(list_last(string_split(lower(trim(symbol)), '.')), '[^a-z0-9_]', '', 'g')"
ENDPOINT = r"regexp_replace(regexp_replace(lower(trim(endpoint)), '[<{][^>}]*[>}]', '*', 'g'), '\s+', ' ', 'g')"


def key_sql(by_file: bool) -> str:
    ep = f"'fc|' || lower(trim(file)) || '|' || lower(trim(category)) || '|' || {ENDPOINT}" if by_file else f"'ep|' || {ENDPOINT} || '|' || lower(trim(category))"
    return f"CASE WHEN {SYMBOL} <> '' THEN 'sym|' || lower(trim(file)) || '|' || lower(trim(category)) || '|' || {SYMBOL} WHEN endpoint <> '' THEN {ep} WHEN line IS NOT NULL THEN 'fl|' || lower(trim(file)) || '|' || lower(trim(category)) || '|' || CAST(line AS VARCHAR) ELSE 'fc|' || lower(trim(file)) || '|' || lower(trim(category)) END"


KEYED = f"{cte('candidates')}, keyed AS (SELECT *, {key_sql(False)} AS key FROM candidates)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("severity"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "candidates").withColumn("found_by", F.array("model"))


def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(_orders(spark, sf_dir))


def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    gates = [filters.severity_gate(orders, t).select(F.lit(t or "").alias("threshold"), "failed") for t in ("critical", "HIGH", None, "urgent")]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def severity_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = severity.normalize(F.col("severity"))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(severity.median_level(level).alias("median"), F.count("*").alias("n"))


def severity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = severity.normalize(F.col("severity"))
    return _orders(spark, sf_dir).select("o_orderkey", level.alias("severity"), severity.exact(F.col("severity")).alias("exact"), severity.index(level).alias("idx"), severity.rank(level).alias("rank"), severity.sarif_level(level).alias("sarif"))


def category_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("seq", category.slug(F.concat(F.lit(" "), "title", F.lit("_X "))).alias("slug"))


def category_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("broken Access control "), "category")).otherwise(F.concat(F.lit("_"), "category", F.lit(" x"))).alias("raw"))
    return rows.select("seq", category.category_of(F.col("raw")).alias("category"))


def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("seq", category.slug(F.col("category")).alias("a"), F.when(F.col("seq") % 2 == 0, "injection").when(F.col("seq") % 5 == 0, "").otherwise("missing-auth-bypass").alias("b"))
    return rows.select("seq", category.category_match(F.col("a"), F.col("b")).alias("matched"))


def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("sql-injection",), ("view",), ("click",)], "id string")
    return category.normalized(_candidates(spark, sf_dir).select("seq", F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("category")).alias("category")), "category", known)


def category_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("injection", ["sql injection", "view"]), ("authorization", ["missing auth", "view"]), ("clicks", None)], "id string, aliases array<string>")
    return category.canonical(_candidates(spark, sf_dir).select("seq", "category"), "category", category.alias_map(classes))


def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_findings(relation(spark, sf_dir, "findings")).select("seq", "file", "line", "category", "description")


def location_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_places(relation(spark, sf_dir, "findings")).select("seq", "file", "line", "category")


def collapse_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapse_colocated(relation(spark, sf_dir, "findings")).select("seq", "file", "line", "category")


def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = filters.filter_findings(relation(spark, sf_dir, "findings"), DEFAULT, ["vendored/"], 0.1)
    return kept.select("seq", F.lit("").alias("reason")).unionByName(dropped.select("seq", "reason"))


def dismissal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "findings").select("seq", "file", "line")
    targets = spark.createDataFrame([("src/view.py:7",), (" src/click.py ",), ("src/error.py:12",), ("",)], "target string")
    return filters.dismissed(rows, targets)


def candidate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("seq", union.candidate_key().alias("key"), union.candidate_key(True).alias("key_by_file"))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = union.fold(_candidates(spark, sf_dir))
    return rows.select("key", "seq", "title", "file", "line", "severity", "evidence", "status", F.array_join("found_by", ",").alias("found_by"), union.consensus(F.col("found_by")).alias("models"), "n_rows")


def pass_new_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union.new_keys_per_pass(_candidates(spark, sf_dir))


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("pass_no").agg((F.max("seq") % 9 != 0).alias("clean"))


def convergence_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = passes.convergence(union.new_keys_per_pass(_candidates(spark, sf_dir)), _passes(spark, sf_dir), 2, 3, 2)
    stop = passes.stop_pass(state, 24)
    return state.select("pass_no", "n_new", "clean", "converged", "covered", stop.select("stop_at").scalar().alias("stop_at"), stop.select("converged").scalar().alias("run_converged"))


def lens_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pass_no")
    return _candidates(spark, sf_dir).select("pass_no").distinct().select("pass_no", passes.lens_of(p, 4).alias("lens"), passes.model_of(p, 4, 3).alias("model"), passes.lenses_covered(p, 4, 2).alias("covered"))


def pass_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passes.replay(_candidates(spark, sf_dir), _passes(spark, sf_dir), max_passes=12)
    return rows.groupBy("pass_no").agg(F.count("*").alias("n"))


def failed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.failed_units(_candidates(spark, sf_dir).select(F.concat_ws(":", "unit", "file").alias("unit"), (F.col("line") > 98).alias("ok")))


def round_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    keys = rows.select(F.col("pass_no").alias("round"), "file", F.lit(None).cast("int").alias("line"), F.lit("x").alias("category")).where("file <> 'src/purchase.py' or round % 3 = 0")
    verdicts = rows.groupBy(F.col("pass_no").alias("round")).agg((F.max("seq") % 4 == 0).alias("agreed"), (F.min("seq") % 2).alias("n_open"))
    return passes.rounds_converged(keys, verdicts)


def report_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.sorted_findings(relation(spark, sf_dir, "findings"))
    return rows.select("seq", "severity", "file", "line")


def consensus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(union.fold(_candidates(spark, sf_dir))).select("key", "severity", "seq")


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(relation(spark, sf_dir, "findings"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(relation(spark, sf_dir, "findings"), ["reviewer"])


def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_sarif(relation(spark, sf_dir, "findings"), ["reviewer"])


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text(relation(spark, sf_dir, "findings"), ["reviewer"])


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_markdown(relation(spark, sf_dir, "findings"), ["reviewer"])


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a reviewer's findings, as provenance; those who found something in the test folder only have none."""
    rows = relation(spark, sf_dir, "findings").where(~F.startswith("file", F.lit("tests/"))).groupBy("reviewer").agg(F.count_distinct("file").cast("string").alias("files"), F.min("seq").cast("string").alias("first"))
    return rows.unpivot("reviewer", ["files", "first"], "field", "value")


def report_target_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.render(relation(spark, sf_dir, "findings"), "json", ["reviewer"], _fields(spark, sf_dir))


def report_target_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.render(relation(spark, sf_dir, "findings"), "text", ["reviewer"], _fields(spark, sf_dir))


def finding_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.finding_names(_candidates(spark, sf_dir)).select("seq", "name")


def surface_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select(F.concat_ws(":", "unit", "file").alias("unit"), (F.col("line") > 98).alias("ok"))
    return report.surface_rows(rows.select("unit").distinct(), passes.failed_units(rows))


def poc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).where("line is not null").select(F.concat("unit", F.lit("-"), F.col("line").cast("string")).alias("name"))
    return report.poc_gaps(rows, rows.where("name like '%0'").select(F.regexp_replace("name", "unit_9", "unit_99").alias("stem")))


def verify_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.tally(relation(spark, sf_dir, "votes"))


def confirmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("m0",), ("m2",), ("",)], "label string")
    rows = union.fold(_candidates(spark, sf_dir)).select("key", "found_by")
    return verify.applicable(rows, labels)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = relation(spark, sf_dir, "votes")
    confirmed = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("").alias("label"), (F.col("o_orderkey") % 7 != 0).alias("completed"), (F.col("o_orderkey") % 3 != 0).alias("holds"))
    return verify.verdicts(votes, confirmed)


def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.totals(_verdicts(spark, sf_dir))


def verify_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_orderkey") % 3).cast("int").alias("models"), (F.col("o_orderkey") % 10 != 0).alias("there"))
    return verify.route(rows, F.col("there"), _verdicts(spark, sf_dir)).select("key", "models", "step")


QUERIES = {f.__name__: f for f in (severity_breakdown, severity_gate, severity_median, severity_ranks, category_slug, category_of, category_match, category_normalize, category_canonical, finding_dedup, location_dedup, collapse_colocated, finding_filter, dismissal_filter, candidate_key, candidate_union, pass_new_counts, convergence_stop, lens_rotation, pass_replay, failed_units, round_convergence, report_sort, consensus_order, sarif_rules, report_json, report_sarif, report_text, report_markdown, report_target_json, report_target_text, finding_names, surface_status, poc_gaps, verify_votes, confirmers, verify_verdicts, verify_totals, verify_route)}

_SLUG = "replace(replace(lower(trim({})), '_', '-'), ' ', '-')"
_NEW = "firsts AS (SELECT key, min(pass_no) AS pass_no FROM keyed GROUP BY key), news AS (SELECT pass_no, count(*) AS n_new FROM firsts GROUP BY pass_no)"
_STATE = f"""{KEYED}, {_NEW}, ps AS (SELECT pass_no, max(seq) % 9 <> 0 AS clean FROM candidates GROUP BY pass_no),
al AS (SELECT ps.pass_no, coalesce(n_new, 0) AS n_new, clean FROM ps LEFT JOIN news USING (pass_no)),
st AS (SELECT pass_no, n_new, clean, sum(n_new) OVER w = 0 AND bool_and(clean) OVER w AND count(*) OVER w = 2 AS converged FROM al WINDOW w AS (ORDER BY pass_no ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"""
_FOLDED = f"""{KEYED}, heads AS (SELECT key, min(seq) AS seq, arg_min(title, seq) AS title, arg_min(file, seq) AS file, arg_min(line, seq) AS line0, bool_or(status = 'confirmed') AS conf, arg_min(status, seq) AS st, count(*) AS n_rows, list_sort(list({RANK})) AS ranks, list_sort(list(DISTINCT model)) AS models FROM keyed GROUP BY key),
lines AS (SELECT key, line FROM keyed k WHERE seq = (SELECT min(seq) FROM keyed z WHERE z.key = k.key)),
ev AS (SELECT key, list_reduce(list_prepend('', list(evidence ORDER BY seq)), lambda a, x: CASE WHEN x = '' OR contains(a, x) THEN a WHEN a = '' THEN x ELSE a || '; ' || x END) AS evidence FROM keyed GROUP BY key),
folded AS (SELECT key, seq, title, file, line, {BY_RANK.format('ranks[CAST(floor(len(ranks) / 2) AS INT) + 1]')} AS severity, evidence, CASE WHEN conf THEN 'confirmed' ELSE st END AS status, array_to_string(models, ',') AS found_by, CAST(len(models) AS INT) AS models, n_rows, models AS model_list FROM heads JOIN lines USING (key) JOIN ev USING (key))"""
_TALLY = "tally AS (SELECT key, count(*) FILTER (completed) AS n_completed, coalesce(bool_or(real) FILTER (completed), false) AS any_real, count(*) FILTER (NOT completed) AS errors, arg_min(reason, vote_no) FILTER (completed AND NOT real) AS reason FROM votes GROUP BY key)"
_VERDICTS = f"""{cte('votes')}, {_TALLY}, cf AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey % 7 <> 0 AS completed, o_orderkey % 3 <> 0 AS holds FROM orders WHERE o_orderstatus <> 'P'),
j AS (SELECT t.*, c.completed AS done, c.completed AND c.holds AS hold, n_completed > 0 AND NOT any_real AS refuted FROM tally t LEFT JOIN cf c USING (key)),
d AS (SELECT *, refuted AND coalesce(NOT done, false) AS broken, refuted AND coalesce(done, true) AND coalesce(hold, false) AS dropped FROM j),
verdicts AS (SELECT key, NOT dropped AS real, n_completed = 0 OR broken AS incomplete, errors + CAST(broken AS INT) AS errors, CASE WHEN dropped THEN coalesce(reason, '') ELSE '' END AS reason FROM d)"""
_FINDINGS_ORDER = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"

_PLACE = "CASE WHEN coalesce(line, 0) <> 0 THEN file || ':' || CAST(line AS VARCHAR) ELSE file END"
_SHOWN = f"x AS (SELECT *, {_PLACE} AS place, row_number() OVER (ORDER BY {_FINDINGS_ORDER}, file, coalesce(line, 0), seq) AS n FROM findings)"
_COUNTS = ", ".join(f"(CASE WHEN count(*) FILTER (severity = '{x}') > 0 THEN CAST(count(*) FILTER (severity = '{x}') AS VARCHAR) || ' {x}' END)" for x in severity.LEVELS)
_SLUGGED = "left(lower(regexp_replace(regexp_replace({}, '[^A-Za-z0-9]', '-', 'g'), '^-+|-+$', '', 'g')), 80)"

#: A double as JSON of the JVM has it: exponents below a thousandth.
_TEXT = "CAST(confidence AS VARCHAR)"
_JSON_DOUBLE = f"""CASE WHEN confidence >= 0.001 OR confidence = 0 THEN {_TEXT} WHEN contains({_TEXT}, 'e') THEN regexp_replace(regexp_replace({_TEXT}, '^([0-9])e', '\\1.0e'), 'e-0?', 'E-')
ELSE regexp_replace(regexp_replace({_TEXT}, '^0\\.000([0-9])([0-9]*)$', '\\1.\\2E-4'), '\\.E', '.0E') END"""
_JSON_LINE = "coalesce(CAST(line AS VARCHAR), 'null')"
_JSON_ITEM = f"""'{{"file":"' || file || '","line":' || {_JSON_LINE} || ',"severity":"' || severity || '","category":"' || category || '","description":"' || description || '","exploit_scenario":"' || exploit_scenario || '","recommendation":"' || recommendation || '","confidence":' || {_JSON_DOUBLE} || '}}'"""
_JSON_COUNTS = " || ',' || ".join(f"""'"{x}":' || CAST(count(*) FILTER (severity = '{x}') AS VARCHAR)""" for x in severity.LEVELS)
_SARIF_RESULT = f"""'{{"ruleId":"' || rule_id || '","ruleIndex":' || CAST(rule_index AS VARCHAR) || ',"level":"' || CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || description || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}}' || CASE WHEN coalesce(line, 0) > 0 THEN ',"region":{{"startLine":' || CAST(line AS VARCHAR) || '}}' ELSE '' END || '}}}}],"properties":{{"severity":"' || severity || '","category":"' || category || '","confidence":' || {_JSON_DOUBLE} || ',"exploitScenario":"' || exploit_scenario || '"}}}}'"""
_SARIF_RULE = """'{"id":"' || rule_id || '","name":"' || rule_id || '","shortDescription":{"text":"' || rule_id || '"}}'"""

_TARGETS = "SELECT reviewer, CAST(count(DISTINCT file) AS VARCHAR) AS files, CAST(min(seq) AS VARCHAR) AS first FROM findings WHERE NOT starts_with(file, 'tests/') GROUP BY reviewer"
SQL = {
    "report_json": f"""WITH {cte('findings')}, {_SHOWN} SELECT reviewer, '{{"findings":[' || string_agg({_JSON_ITEM}, ',' ORDER BY n) || '],"summary":{{' || {_JSON_COUNTS} || '}}}}' AS report FROM x GROUP BY reviewer""",
    "report_sarif": f"""WITH {cte('findings')}, {_SHOWN}, r AS (SELECT *, CASE WHEN category = '' THEN 'security' ELSE category END AS rule_id FROM x), f AS (SELECT reviewer, rule_id, min(n) AS first FROM r GROUP BY ALL), ix AS (SELECT reviewer, rule_id, row_number() OVER (PARTITION BY reviewer ORDER BY first) - 1 AS rule_index FROM f),
a AS (SELECT reviewer, string_agg({_SARIF_RESULT}, ',' ORDER BY n) AS results FROM r JOIN ix USING (reviewer, rule_id) GROUP BY reviewer), b AS (SELECT reviewer, string_agg({_SARIF_RULE}, ',' ORDER BY rule_index) AS rules FROM ix GROUP BY reviewer)
SELECT reviewer, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"siftstone","rules":[' || rules || ']}}}},"results":[' || results || ']}}]}}' AS report FROM a JOIN b USING (reviewer)""",
    "severity_breakdown": f"WITH {ORDERS}, ls AS (SELECT * FROM (VALUES {LEVELS}) t(severity)) SELECT ls.severity, count(o_orderkey) AS n FROM ls LEFT JOIN lv ON lv.severity = ls.severity GROUP BY ls.severity",
    "severity_gate": f"WITH {ORDERS} SELECT 'critical' AS threshold, bool_or(severity = 'CRITICAL') AS failed FROM lv UNION ALL SELECT 'HIGH', bool_or(severity IN ('CRITICAL', 'HIGH')) FROM lv UNION ALL SELECT '', false UNION ALL SELECT 'urgent', false",
    "severity_median": f"WITH {ORDERS}, r AS (SELECT o_custkey, list_sort(list({RANK})) AS xs FROM lv GROUP BY o_custkey), m AS (SELECT *, {BY_RANK.format('xs[CAST(floor(len(xs) / 2) AS INT) + 1]')} AS med FROM r) SELECT o_custkey, med AS median, CAST(len(xs) AS BIGINT) AS n FROM m",
    "severity_ranks": f"WITH {ORDERS} SELECT lv.o_orderkey, severity, 'MEDIUM' AS exact, CAST({_FINDINGS_ORDER} AS INT) AS idx, CAST({RANK} AS INT) AS rank, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS sarif FROM lv",
    "category_slug": f"WITH {cte('candidates')} SELECT seq, {_SLUG.format(chr(39) + ' ' + chr(39) + ' || title || ' + chr(39) + '_X ' + chr(39))} AS slug FROM candidates",
    "category_of": f"WITH {cte('candidates')}, r AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN 'broken Access control ' || category ELSE '_' || category || ' x' END AS raw FROM candidates), l AS (SELECT seq, lower(trim(raw)) AS t FROM r) SELECT seq, CASE WHEN contains(t, 'missing auth') OR contains(t, 'authorization') OR contains(t, 'authz') OR contains(t, 'access control') OR contains(t, 'broken access') THEN 'missing-authorization' ELSE trim(regexp_replace(t, '[\\s_]+', '-', 'g'), '-') END AS category FROM l",
    "category_match": f"WITH {cte('candidates')}, r AS (SELECT seq, {_SLUG.format('category')} AS a, CASE WHEN seq % 2 = 0 THEN 'injection' WHEN seq % 5 = 0 THEN '' ELSE 'missing-auth-bypass' END AS b FROM candidates) SELECT seq, a <> '' AND b <> '' AND (a = b OR list_has_all(string_split(b, '-'), string_split(a, '-')) OR list_has_all(string_split(a, '-'), string_split(b, '-'))) AS matched FROM r",
    "category_normalize": f"WITH {cte('candidates')}, r AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN '' ELSE {_SLUG.format('category')} END AS s FROM candidates) SELECT seq, CASE WHEN s = '' THEN '' WHEN s IN ('sql-injection', 'view', 'click') THEN s ELSE 'other' END AS category FROM r",
    "category_canonical": f"WITH {cte('candidates')} SELECT seq, CASE {_SLUG.format('category')} WHEN 'sql-injection' THEN 'injection' WHEN 'view' THEN 'injection' WHEN 'missing-auth' THEN 'authorization' ELSE {_SLUG.format('category')} END AS category FROM candidates",
    "finding_dedup": f"WITH {cte('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY file, line, category, description ORDER BY seq) AS n FROM findings) SELECT seq, file, line, category, description FROM r WHERE n = 1",
    "location_dedup": f"WITH {cte('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY file, line, category ORDER BY seq) AS n FROM findings) SELECT seq, file, line, category FROM r WHERE n = 1",
    "collapse_colocated": f"WITH {cte('findings')}, r AS (SELECT *, row_number() OVER (PARTITION BY file, line, category ORDER BY seq) AS n FROM findings) SELECT seq, file, line, category FROM r WHERE n = 1 OR line IS NULL",
    "finding_filter": f"WITH {cte('findings')} SELECT seq, CASE WHEN confidence < 0.1 THEN 'low confidence' WHEN file LIKE 'tests/%' THEN 'test path' WHEN contains(file, 'vendored/') THEN 'excluded path' ELSE '' END AS reason FROM findings",
    "dismissal_filter": f"WITH {cte('findings')} SELECT seq, file, line FROM findings WHERE file <> 'src/click.py' AND NOT (file = 'src/view.py' AND coalesce(line, 0) = 7) AND NOT (file = 'src/error.py' AND coalesce(line, 0) = 12)",
    "candidate_key": f"WITH {cte('candidates')} SELECT seq, {key_sql(False)} AS key, {key_sql(True)} AS key_by_file FROM candidates",
    "candidate_union": f"WITH {_FOLDED} SELECT key, seq, title, file, line, severity, evidence, status, found_by, models, n_rows FROM folded",
    "pass_new_counts": f"WITH {KEYED}, {_NEW} SELECT * FROM news",
    "convergence_stop": f"WITH {_STATE}, cv AS (SELECT *, floor(pass_no / 3) >= 2 AS covered FROM st), sp AS (SELECT coalesce(min(pass_no) FILTER (converged AND covered AND pass_no <= 24), least(max(pass_no), 24)) AS stop_at, min(pass_no) FILTER (converged AND covered AND pass_no <= 24) IS NOT NULL AS run_converged FROM cv) SELECT cv.*, stop_at, run_converged FROM cv, sp",
    "lens_rotation": f"WITH {cte('candidates')} SELECT DISTINCT pass_no, CAST((pass_no - 1) % 4 AS INT) AS lens, CAST(floor((pass_no - 1) / 4) AS INT) % 3 AS model, floor(pass_no / 4) >= 2 AS covered FROM candidates",
    "pass_replay": f"WITH {_STATE}, sp AS (SELECT coalesce(min(pass_no) FILTER (converged AND pass_no <= 12), least(max(pass_no), 12)) AS stop_at FROM st) SELECT pass_no, count(*) AS n FROM candidates, sp WHERE pass_no <= stop_at GROUP BY pass_no",
    "failed_units": f"WITH {cte('candidates')} SELECT unit || ':' || file AS unit FROM candidates GROUP BY unit, file HAVING NOT coalesce(bool_or(line > 98), false)",
    "round_convergence": f"WITH {cte('candidates')}, ks AS (SELECT DISTINCT pass_no AS round, file FROM candidates WHERE file <> 'src/purchase.py' OR pass_no % 3 = 0), s AS (SELECT round, list_sort(list(file)) AS fs, count(*) AS n_keys FROM ks GROUP BY round), v AS (SELECT pass_no AS round, max(seq) % 4 = 0 AS agreed, min(seq) % 2 AS n_open FROM candidates GROUP BY pass_no), j AS (SELECT v.*, coalesce(n_keys, 0) AS n_keys, coalesce(lag(fs) OVER (ORDER BY v.round) = fs, false) AS same FROM v LEFT JOIN s ON s.round = v.round) SELECT round, n_keys, (agreed OR same) AND n_open = 0 AS final FROM j",
    "report_sort": f"WITH {cte('findings')} SELECT seq, severity, file, line FROM findings ORDER BY {_FINDINGS_ORDER}, file, coalesce(line, 0), seq",
    "consensus_order": f"WITH {_FOLDED} SELECT key, severity, seq FROM folded ORDER BY models DESC, {_FINDINGS_ORDER}, seq",
    "sarif_rules": f"WITH {cte('findings')}, r AS (SELECT CASE WHEN category = '' THEN 'security' ELSE category END AS rule_id, row_number() OVER (ORDER BY {_FINDINGS_ORDER}, file, coalesce(line, 0), seq) AS n FROM findings WHERE file <> ''), f AS (SELECT rule_id, min(n) AS n FROM r GROUP BY rule_id) SELECT rule_id, CAST(row_number() OVER (ORDER BY n) - 1 AS INT) AS rule_index FROM f",
    "surface_status": f"WITH {cte('candidates')} SELECT unit || ':' || file AS unit, CASE WHEN coalesce(bool_or(line > 98), false) THEN 'reviewed' ELSE 'open' END AS status FROM candidates GROUP BY unit, file",
    "poc_gaps": f"WITH {cte('candidates')}, f AS (SELECT DISTINCT unit || '-' || CAST(line AS VARCHAR) AS name FROM candidates WHERE line IS NOT NULL), p AS (SELECT DISTINCT replace(name, 'unit_9', 'unit_99') AS name FROM f WHERE name LIKE '%0') SELECT name, 'no proof' AS gap FROM f WHERE name NOT IN (SELECT name FROM p) UNION ALL SELECT name, 'no finding' FROM p WHERE name NOT IN (SELECT name FROM f WHERE name IS NOT NULL)",
    "verify_votes": f"WITH {cte('votes')}, {_TALLY} SELECT * FROM tally",
    "confirmers": f"WITH {_FOLDED} SELECT key, label FROM folded, (VALUES ('m0'), ('m2'), ('')) t(label) WHERE label = '' OR NOT list_contains(model_list, label)",
    "verify_verdicts": f"WITH {_VERDICTS} SELECT * FROM verdicts",
    "verify_totals": f"WITH {_VERDICTS} SELECT count(*) FILTER (real) AS confirmed, count(*) FILTER (NOT real) AS refuted, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (real AND incomplete) AS incomplete FROM verdicts",
    "verify_route": f"WITH {_VERDICTS} SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey % 3 AS INT) AS models, CASE WHEN o_orderkey % 3 >= 2 THEN 'consensus' WHEN o_orderkey % 10 = 0 THEN 'unlocatable' WHEN NOT coalesce(real, true) THEN 'refuted' WHEN coalesce(incomplete, true) THEN 'kept' ELSE 'verified' END AS step FROM orders LEFT JOIN verdicts ON verdicts.key = CAST(o_orderkey AS VARCHAR)",
    "report_target_json": f"""WITH {cte('findings')}, {_SHOWN}, t AS ({_TARGETS}) SELECT reviewer, '{{"findings":[' || string_agg({_JSON_ITEM}, ',' ORDER BY n) || '],"summary":{{' || {_JSON_COUNTS} || '}},"target":' || coalesce('{{"files":"' || any_value(files) || '","first":"' || any_value(first) || '"}}', 'null') || '}}' AS report FROM x LEFT JOIN t USING (reviewer) GROUP BY reviewer""",
    "report_target_text": f"WITH {cte('findings')}, {_SHOWN}, t AS ({_TARGETS}) SELECT reviewer, coalesce('Target:' || chr(10) || '- files: ' || any_value(files) || chr(10) || '- first: ' || any_value(first) || chr(10) || chr(10), '') || string_agg('[' || severity || '] ' || place || ' ' || category || chr(10) || '  ' || description, chr(10) ORDER BY n) AS report FROM x LEFT JOIN t USING (reviewer) GROUP BY reviewer",
    "report_text": f"WITH {cte('findings')}, {_SHOWN} SELECT reviewer, string_agg('[' || severity || '] ' || place || ' ' || category || chr(10) || '  ' || description, chr(10) ORDER BY n) AS report FROM x GROUP BY reviewer",
    "report_markdown": f"WITH {cte('findings')}, {_SHOWN} SELECT reviewer, '# Review: ' || CAST(count(*) AS VARCHAR) || ' findings (' || concat_ws(', ', {_COUNTS}) || ')' || chr(10) || chr(10) || string_agg('## ' || severity || ': ' || category || ' at `' || place || '`' || chr(10) || chr(10) || description || chr(10) || chr(10) || 'Scenario: ' || exploit_scenario, chr(10) || chr(10) ORDER BY n) AS report FROM x GROUP BY reviewer",
    "finding_names": f"WITH {cte('candidates')}, b AS (SELECT seq, severity, {_SLUGGED.format('(' + _PLACE + ") || '-' || category")} AS base FROM candidates), r AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY {_FINDINGS_ORDER}, seq) AS n FROM b), m AS (SELECT seq, n, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS VARCHAR) END AS name FROM r), a AS (SELECT seq, name, row_number() OVER (PARTITION BY name ORDER BY n, seq) AS k FROM m) SELECT seq, CASE WHEN k = 1 THEN name ELSE name || '-' || CAST(seq AS VARCHAR) END AS name FROM a",
}
