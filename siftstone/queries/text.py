"""Queries on endpoints, texts, chunks, packing and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import coerce, endpoint, jsonscan, lines, location
from siftstone.operators import chunk
from siftstone.queries.adapters import cte, dealt, relation
from siftstone.sources import notes
from siftstone.sources.rules import DEFAULT


def endpoint_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "endpoints").select("page_id", endpoint.normalize(F.col("entry")).alias("entry"), endpoint.normalize(F.col("report")).alias("report"))


def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "endpoints")
    return rows.select("page_id", endpoint.endpoint_match(F.col("report"), F.col("entry")).alias("same"), endpoint.endpoint_match(F.lit("PUT /x/en/<id>, get /y"), F.col("entry")).alias("fixed"))


def endpoint_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "endpoints")
    found = endpoint.routes(endpoint.normalize(F.col("report")))
    return rows.select("page_id", F.posexplode(found).alias("i", "route")).select("page_id", "i", "route", endpoint.method(F.col("route")).alias("method"), F.size(endpoint.segments(F.col("route"))).alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "files")


def diff_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.pack(_files(spark, sf_dir), "source", "doc_id", "size")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each document: a file section for each of its first lines."""
    head = F.concat(F.lit("diff --git a/x b/"), "path", F.lit("\n--- a/x\n+++ "), F.when(F.col("doc_id") % 3 == 0, "/dev/null").otherwise(F.concat(F.lit("b/"), "path")), F.lit("\n"))
    body = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.lit(" \n")).otherwise(F.concat(head, F.lit("+"), F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), head, F.lit("+")))))
    return _files(spark, sf_dir).select("doc_id", body.alias("diff"))


def diff_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.split_diff(_diffs(spark, sf_dir)).select("doc_id", "chunk_no", F.length("chunk").alias("n"), "path")


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("doc_id", F.array_join(location.changed_paths(F.col("diff")), ",").alias("paths"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.windowed(_files(spark, sf_dir), 1000, 100)


def chunk_windows_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.windowed(_files(spark, sf_dir))


def gather_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumn("n", F.length("text"))
    return chunk.within_budget(rows, ["source"], ["path"], "n").select("source", "path", "taken")


def gather_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.gathered(_files(spark, sf_dir), ["source"], ["path"])
    return rows.select("source", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


def capped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("source", "doc_id", F.col("text").alias("block"))
    return chunk.capped_text(rows, ["source"], ["doc_id"]).select("source", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


def review_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    units = chunk.review_units(rows.where("path like '%.py'").select("path", "text"), rows.where("path like '%.go'").select("path"))
    return units.select("path", "window_no", "start", "end", F.array_join("files", ",").alias("files"))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    return rows.select("doc_id", F.sha2(lines.numbered(F.col("text")), 256).alias("digest"), lines.line_at(F.col("text"), F.lit(500)).alias("line"), lines.span_lines(F.col("text"), F.lit(100), F.lit(900))["last"].alias("last"), F.size(lines.boundaries(F.col("text"))).alias("starts"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate note for each event."""
    rows = dealt(relation(spark, sf_dir, "candidates"), "seq")
    status = F.when(F.col("seq") % 7 == 0, "Refuted").when(F.col("seq") % 7 == 1, "cleared").otherwise("open")
    place = F.when(F.col("seq") % 11 == 0, "").when(F.col("seq") % 11 == 1, "/etc/x.py").otherwise(F.concat("file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?"))))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n- Status: "), status, F.lit("\n- Location: `"), place, F.lit("`\n- Class: "), "category", F.lit("\n- Risk: "), "severity", F.lit("\n\n## Evidence\n\nsee "), "file", F.lit(":7 and src/view.py:12 "), "evidence", F.lit("\n"))
    return rows.select(F.col("seq").cast("string").alias("name"), text.alias("text"))


def candidate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.candidate_notes(_notes(spark, sf_dir)).select("name", "title", "category", "file", "line", "severity", "status", F.length("evidence").alias("n"))


def finding_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.finding_notes(_notes(spark, sf_dir), DEFAULT["source_ext"])
    return rows.select("name", "category", F.array_join("files", ",").alias("files"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each event: findings as JSON, with values of many kinds."""
    rows = relation(spark, sf_dir, "findings")
    line = F.when(F.col("seq") % 5 == 0, "true").when(F.col("seq") % 5 == 1, '"3"').when(F.col("seq") % 5 == 2, "0").otherwise(F.coalesce(F.col("line").cast("string"), F.lit("null")))
    conf = F.when(F.col("seq") % 4 == 0, "true").when(F.col("seq") % 4 == 1, '"0.7"').when(F.col("seq") % 4 == 2, "1.5").otherwise("0.25")
    file = F.when(F.col("seq") % 6 == 0, " ").otherwise(F.col("file"))
    item = F.concat(F.lit('{"file": "'), file, F.lit('", "line": '), line, F.lit(', "severity": "'), F.when(F.col("seq") % 3 == 0, F.lower("severity")).when(F.col("seq") % 3 == 1, " HIGH").otherwise(F.col("severity")), F.lit('", "category": "'), "category", F.lit('", "confidence": '), conf, F.lit("}"))
    return rows.select("seq", F.concat(F.lit('{"findings": ['), item, F.lit("]}")).alias("reply"))


def finding_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("seq", F.inline(coerce.findings(F.col("reply")))).select("seq", "file", "line", "severity", "category", "confidence")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    reply = F.when(F.col("seq") % 4 == 0, F.col("reply")).when(F.col("seq") % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), "reply", F.lit("\n```\n"))).when(F.col("seq") % 4 == 2, F.concat(F.lit('I found "{" and '), "reply", F.lit(" so."))).otherwise("[1, 2, 3]")
    found = jsonscan.json_object(reply)
    return rows.select("seq", found.isNotNull().alias("ok"), F.get_json_object(found, "$.findings[0].category").alias("category"))


def reply_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "candidates")
    reply = F.to_json(F.struct(F.array(F.struct(F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.lit("described").alias("description"), "category", F.when(F.col("seq") % 4 == 0, "/abs.py").otherwise(F.col("file")).alias("file"), "line", "severity")).alias("findings")))
    return rows.select("seq", F.inline(coerce.candidates(reply))).select("seq", "title", "file", "line", "severity")


QUERIES = {f.__name__: f for f in (endpoint_normalize, endpoint_match, endpoint_routes, diff_pack, diff_split, changed_paths, chunk_windows, chunk_windows_full, gather_budget, gather_text, capped_blocks, review_units, line_numbers, candidate_notes, finding_reports, finding_coerce, json_extract, reply_candidates)}

_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({c})), '`', ''), '\?\S*', '', 'g'), '\([^)]*\)', ' ', 'g'), '[<{{][^>}}]*[>}}]', '*', 'g'), '\s+', ' ', 'g'))"
_SEGMENTS = "list_filter(string_split(CASE WHEN contains({0}, ' ') THEN {0}[strpos({0}, ' ') + 1:] ELSE {0} END, '/'), lambda s: s <> '')"
_METHOD = "CASE WHEN contains({0}, ' ') AND split_part({0}, ' ', 1) IN ('get', 'post', 'put', 'patch', 'delete', 'head', 'options') THEN split_part({0}, ' ', 1) ELSE '' END"
_ROUTES = f"norm AS (SELECT page_id, {_NORM('entry')} AS entry, {_NORM('report')} AS report FROM endpoints), rt AS (SELECT page_id, entry, list_filter(list_transform(string_split(regexp_replace(report, '\\b(get|post|put|patch|delete|head|options)(\\s)', ',\\1\\2', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS routes FROM norm)"
_ONE = """(m = '' OR n = '' OR m = n) AND len(a) > 0 AND len(b) > 0 AND (CASE WHEN len(a) <= len(b) THEN a[1] ELSE b[1] END) = (CASE WHEN len(a) <= len(b) THEN b[len(b) - len(a) + 1] ELSE a[len(a) - len(b) + 1] END)
AND len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: NOT (a[len(a) - i + 1] = b[len(b) - i + 1] OR a[len(a) - i + 1] = '*' OR b[len(b) - i + 1] = '*'))) = 0"""
_PACK = """ord AS (SELECT source, doc_id, size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM files),
fold AS (SELECT source, doc_id, rn, size AS total, 0 AS batch FROM ord WHERE rn = 1 UNION ALL
SELECT o.source, o.doc_id, o.rn, CASE WHEN f.total = 0 OR f.total + o.size <= 60000 THEN f.total + o.size ELSE o.size END, CASE WHEN f.total = 0 OR f.total + o.size <= 60000 THEN f.batch ELSE f.batch + 1 END FROM fold f JOIN ord o ON o.source = f.source AND o.rn = f.rn + 1)"""
_DIFFS = "head AS (SELECT doc_id, path, text, 'diff --git a/x b/' || path || chr(10) || '--- a/x' || chr(10) || '+++ ' || CASE WHEN doc_id % 3 = 0 THEN '/dev/null' ELSE 'b/' || path END || chr(10) AS head FROM files), diffs AS (SELECT doc_id, path, head, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(10) ELSE head || '+' || replace(text, chr(10), chr(10) || head || '+') END AS diff FROM head)"
_WINDOWS = """b AS (SELECT path, text, length(text) AS size, list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN regexp_matches(string_split(text, chr(10))[i], '^\\S') THEN coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i - 1], lambda l: length(l) + 1)), 0) ELSE -1 END), lambda x: x >= 0) AS bs FROM files),
w AS (SELECT path, size, bs, 0 AS no, 0 AS s, CAST(CASE WHEN size <= {w} THEN size ELSE coalesce(list_max(list_filter(bs, lambda x: x > 0 AND x <= {w})), {w}) END AS BIGINT) AS e, CAST(CASE WHEN size <= {w} THEN -1 ELSE coalesce(list_max(list_filter(bs, lambda x: x > 0 AND x <= {w})), {w} - {o}) END AS BIGINT) AS nx FROM b
UNION ALL SELECT path, size, bs, no + 1, CAST(nx AS INT), CAST(CASE WHEN nx + {w} >= size THEN size ELSE coalesce(list_max(list_filter(bs, lambda x: x > nx AND x <= nx + {w})), nx + {w}) END AS BIGINT), CAST(CASE WHEN nx + {w} >= size THEN -1 ELSE coalesce(list_max(list_filter(bs, lambda x: x > nx AND x <= nx + {w})), nx + {w} - {o}) END AS BIGINT) FROM w WHERE nx >= 0)"""

_NUMBERED = "array_to_string(list_transform(range(1, len(string_split({0}, chr(10))) + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(string_split({0}, chr(10))) AS VARCHAR)) AS INT), ' ') || ' | ' || string_split({0}, chr(10))[i]), chr(10))"
_SPANS = 'w.path, CAST(no AS INT) AS window_no, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end"'
_LINES = "CAST(len(string_split(b.text[1:s], chr(10))) AS INT) AS first, CAST(len(string_split(b.text[1:greatest(s, e - 1)], chr(10))) AS INT) AS last"

SQL = {
    "endpoint_normalize": f"WITH {cte('endpoints')} SELECT page_id, {_NORM('entry')} AS entry, {_NORM('report')} AS report FROM endpoints",
    "endpoint_match": f"""WITH {cte('endpoints')}, {_ROUTES}, x AS (SELECT page_id, entry, unnest(routes) AS r, true AS own FROM rt UNION ALL SELECT page_id, entry, unnest(['put /x/en/*', 'get /y']), false FROM rt),
p AS (SELECT page_id, own, {_METHOD.format('r')} AS m, {_METHOD.format('entry')} AS n, {_SEGMENTS.format('r')} AS a, {_SEGMENTS.format('entry')} AS b FROM x)
SELECT page_id, bool_or(own AND {_ONE}) AS same, bool_or(NOT own AND {_ONE}) AS fixed FROM p GROUP BY page_id""",
    "endpoint_routes": f"WITH {cte('endpoints')}, {_ROUTES}, x AS (SELECT page_id, unnest(routes) AS route, CAST(unnest(range(0, len(routes))) AS INT) AS i FROM rt) SELECT page_id, i, route, {_METHOD.format('route')} AS method, CAST(len({_SEGMENTS.format('route')}) AS INT) AS n FROM x",
    "diff_pack": f"WITH RECURSIVE {cte('files')}, {_PACK} SELECT source, doc_id, batch FROM fold",
    "diff_split": f"WITH {cte('files')}, {_DIFFS}, one AS (SELECT doc_id, 0 AS chunk_no, length(diff) AS n, '' AS path FROM diffs WHERE doc_id % 4 = 0), ls AS (SELECT doc_id, path, head, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS k FROM head WHERE doc_id % 4 >= 2) SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(n AS INT) AS n, path FROM one UNION ALL SELECT doc_id, i, length(head) + 1 + length(line) + CASE WHEN i < k - 1 THEN 1 ELSE 0 END, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE path END FROM ls",
    "changed_paths": f"WITH {cte('files')}, {_DIFFS} SELECT doc_id, CASE WHEN doc_id % 4 >= 2 AND doc_id % 3 <> 0 THEN path ELSE '' END AS paths FROM diffs",
    "chunk_windows": f"WITH RECURSIVE {cte('files')}, {_WINDOWS.format(w=1000, o=100)} SELECT w.path, CAST(no AS INT) AS window_no, CAST(s AS INT) AS \"start\", CAST(e AS INT) AS \"end\", CAST(len(string_split(b.text[1:s], chr(10))) AS INT) AS first, CAST(len(string_split(b.text[1:greatest(s, e - 1)], chr(10))) AS INT) AS last FROM w JOIN b ON b.path = w.path",
    "gather_budget": f"WITH {cte('files')}, c AS (SELECT source, path, CAST(least(length(text), 24000) AS INT) AS taken FROM files), s AS (SELECT *, coalesce(sum(taken) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT source, path, taken FROM s WHERE before < 120000",
    "candidate_notes": f"WITH {cte('candidates')} SELECT CAST(seq AS VARCHAR) AS name, title, category, file, line, severity, 'open' AS status, CAST(length('## Evidence' || chr(10) || chr(10) || 'see ' || file || ':7 and src/view.py:12 ' || evidence || chr(10)) AS INT) AS n FROM candidates WHERE seq % 7 NOT IN (0, 1) AND seq % 11 NOT IN (0, 1)",
    "finding_coerce": f"WITH {cte('findings')} SELECT seq, file, CASE WHEN seq % 5 IN (0, 1, 2) THEN NULL ELSE line END AS line, CASE WHEN seq % 3 = 1 THEN 'MEDIUM' ELSE severity END AS severity, category, CASE seq % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence FROM findings WHERE seq % 6 <> 0",
    "json_extract": f"WITH {cte('findings')} SELECT seq, seq % 4 <> 3 AS ok, CASE WHEN seq % 4 <> 3 THEN category END AS category FROM findings",
    "reply_candidates": f"WITH {cte('candidates')} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'described' ELSE title END AS title, CASE WHEN seq % 4 = 0 THEN '' ELSE file END AS file, line, severity FROM candidates",
    "chunk_windows_full": f"WITH RECURSIVE {cte('files')}, {_WINDOWS.format(w=24000, o=2000)} SELECT {_SPANS}, {_LINES} FROM w JOIN b ON b.path = w.path",
    "review_units": f"""WITH RECURSIVE {cte('files')}, {_WINDOWS.format(w=24000, o=2000).replace('FROM files)', "FROM files WHERE path LIKE '%.py')")},
tg AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS n FROM files WHERE path LIKE '%.go'), tl AS (SELECT source, string_agg(path, ',' ORDER BY path) AS ts FROM tg WHERE n <= 20 GROUP BY source)
SELECT {_SPANS}, w.path || coalesce(',' || ts, '') AS files FROM w LEFT JOIN tl ON tl.source = split_part(w.path, '/', 1)""",
    "gather_text": f"WITH {cte('files')}, c AS (SELECT source, path, text, least(length(text), 24000) AS taken FROM files), s AS (SELECT *, coalesce(sum(taken) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), t AS (SELECT source, path, text[1:taken] AS t FROM s WHERE before < 120000), j AS (SELECT source, string_agg('### ' || path || chr(10) || {_NUMBERED.format('t')}, chr(10) || chr(10) ORDER BY path) AS t FROM t GROUP BY source) SELECT source, sha256(t) AS digest, CAST(length(t) AS INT) AS n FROM j",
    "capped_blocks": f"WITH {cte('files')}, d AS (SELECT source, text AS block, min(doc_id) AS doc_id FROM files GROUP BY ALL), s AS (SELECT *, coalesce(sum(least(length(block), 16000)) OVER (PARTITION BY source ORDER BY doc_id, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d), j AS (SELECT source, string_agg(block, chr(10) || chr(10) ORDER BY doc_id, block) AS t FROM s WHERE before < 16000 GROUP BY source), c AS (SELECT source, CASE WHEN length(t) > 16000 THEN t[1:16000] || chr(10) || '... truncated' ELSE t END AS t FROM j) SELECT source, sha256(t) AS digest, CAST(length(t) AS INT) AS n FROM c",
    "line_numbers": f"WITH {cte('files')}, h AS (SELECT doc_id, text, text AS t FROM files) SELECT doc_id, sha256({_NUMBERED.format('t')}) AS digest, CAST(len(string_split(text[1:500], chr(10))) AS INT) AS line, CAST(len(string_split(text[1:899], chr(10))) AS INT) AS last, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\S'))) AS INT) AS starts FROM h",
    "finding_reports": f"WITH {cte('candidates')}, r AS (SELECT *, seq % 11 > 1 AND line IS NOT NULL AS pinned FROM candidates) SELECT CAST(seq AS VARCHAR) AS name, CASE category WHEN 'SQL_Injection' THEN 'sql-injection' WHEN 'missing auth' THEN 'missing-authorization' ELSE category END AS category, array_to_string(list_sort(list_distinct(list_concat(['src/view.py', file], CASE WHEN seq % 11 = 1 THEN ['/etc/x.py'] ELSE [file] END))), ',') AS files, array_to_string(list_sort(list_distinct(CASE WHEN pinned THEN [7, 12, line] ELSE [7, 12] END)), ',') AS lines FROM r",
}
