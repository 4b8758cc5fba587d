"""Queries on knowledge and the call graph: triggers, guides, coverage, units of calls, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import callgraph, coverage, filters, select, usage
from siftstone.queries.adapters import cte, relation
from siftstone.session import checkpointed


def _triggers(spark: SparkSession) -> DataFrame:
    """A class for each word, some with several triggers."""
    rows = [("v-the", "the was"), ("v-que", "que la"), ("v-die", "der die"), ("v-los", "de los"), ("v-ing", "ing the"), ("v-the", "and the"), ("v-none", "zzzz"), ("v-est", "est le"), ("v-del", "del"), ("v-von", "von")]
    return spark.createDataFrame(rows, "vuln_id string, trigger string")


def _vulns(spark: SparkSession) -> DataFrame:
    rows = [("v-the", "high"), ("v-que", "Critical"), ("v-die", "low"), ("v-los", "medium"), ("v-ing", "odd"), ("v-none", "critical"), ("v-est", "high"), ("v-del", "high"), ("v-von", "low")]
    return spark.createDataFrame(rows, "id string, impact string")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("diff_id"), F.upper("text").alias("text"))


def trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.triggered(_diffs(spark, sf_dir), _triggers(spark))


def trigger_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_classes(select.triggered(_diffs(spark, sf_dir), _triggers(spark)), _vulns(spark), 3)


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("needle"))
    return select.contained(docs, bench).select("doc_id", "item_id")


def guide_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = relation(spark, sf_dir, "files")
    guides = spark.createDataFrame([(0, "python"), (1, "go"), (2, "flask"), (3, "oauth"), (4, "capital"), (5, "none")], "seq int, id string")
    rows = [("python", "file", "src1*/*.py"), ("go", "manifest", "zzz"), ("go", "file", "*.xyz"), ("flask", "manifest", "and"), ("oauth", "content", "the was"), ("capital", "import", "The"), ("none", "content", "zzzz"), ("none", "file", "")]
    signals = spark.createDataFrame(rows, "guide_id string, signal string, pattern string")
    return select.select_guides(files, files.where("path like '%.lock'").select("text"), files.select("text"), guides, signals)


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.matrix(_items(spark, sf_dir), _uses(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "items").groupBy("ref").agg(F.min("kind").alias("kind")).where("ref not like '%5'")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "items")
    cases = rows.where("id % 2 = 0").select(F.array("ref").alias("refs"), (F.col("size") > 25).alias("positive"))
    entries = rows.where("id % 2 = 1").select(F.when(F.col("id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("ref")).alias("refs"), (F.col("size") > 40).alias("planted"), F.when(F.col("id") % 3 == 0, "private").otherwise("public").alias("provenance"))
    return coverage.uses(cases, entries)


def coverage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "items")
    entries = rows.select(F.concat(F.lit("e"), "id").alias("id"), F.lit("b").alias("benchmark"), F.when(F.col("id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("ref")).alias("refs"))
    manifests = spark.createDataFrame([("b", ["vuln:brand-11", "vuln:nowhere"])], "id string, refs array<string>")
    return coverage.problems(coverage_matrix(spark, sf_dir), coverage.referenced(manifests, entries), entries)


def case_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "items")
    refs = coverage.case_refs(F.when(F.col("id") % 3 == 0, F.array("ref")).otherwise(F.array().cast("array<string>")), F.when(F.col("id") % 3 == 1, F.col("tag")).otherwise(""))
    return rows.select("id", F.array_join(refs, ",").alias("refs"))


def suite_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "items").select("id", "kind", F.split("tag", " ").alias("tags"))
    some = filters.select_items(rows, ["small", "promo"], ["guide"]).select("id", F.lit("some").alias("suite"))
    return some.unionByName(filters.select_items(rows, [], ["vulnerability"]).select("id", F.lit("all tags").alias("suite")))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by name, written once: a query reads them several times."""
    rows = relation(spark, sf_dir, "functions").groupBy("fn", "contract").agg(F.max(F.col("flag") == "R").alias("external_call"), F.max(F.col("line") == 7).alias("sends_eth"), F.sum("quantity").cast("int").alias("n"))
    rows = checkpointed(rows)
    start = F.pmod(F.col("n") * 7, F.lit(1000)).cast("int")
    return rows.select("contract", "fn", F.concat(F.lit("src/"), "contract", F.lit(".sol")).alias("file"), F.lit("public").alias("visibility"), "external_call", "sends_eth", F.lit(False).alias("can_reenter"), F.when(F.col("n") % 10 != 0, start).alias("start"), F.when(F.col("n") % 10 != 0, start + F.col("n") * 10).alias("end"), "n")


def _calls(functions: DataFrame) -> DataFrame:
    """A function calls the next two of its contract, by name."""
    from pyspark.sql import Window

    order = Window.partitionBy("contract").orderBy("fn")
    rows = functions.select("contract", "fn", F.lead("fn", 1).over(order).alias("a"), F.lead("fn", 2).over(order).alias("b"))
    return rows.select("contract", F.col("fn").alias("caller"), F.posexplode(F.array("a", "b")).alias("seq", "callee")).where("callee is not null")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units_of(_functions(spark, sf_dir))


def _units_of(functions: DataFrame) -> DataFrame:
    return callgraph.call_path_units(functions, _calls(functions), F.col("external_call") & F.col("sends_eth"), 2500)


def call_path_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("contract", "anchor", "name", F.array_join("fns", ",").alias("fns"), "chars")


def call_path_subsume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.without_contained(_units(spark, sf_dir), ["contract", "anchor"]).select("contract", "anchor", F.array_join("fns", ",").alias("fns"))


def call_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = _functions(spark, sf_dir)
    rows = callgraph.neighbours(functions, _calls(functions), F.col("external_call") & F.col("sends_eth"))
    return rows.select("contract", "anchor", "fn", "hop", "seq", "size")


def call_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = _functions(spark, sf_dir)
    return callgraph.fragments(_units_of(functions), functions)


def facts_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = _functions(spark, sf_dir)
    rows = callgraph.call_graph_blocks(functions, _calls(functions))
    return rows.select("contract", "file", F.sha2("block", 256).alias("digest"))


def facts_for_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = _functions(spark, sf_dir)
    facts = callgraph.call_graph_blocks(functions, _calls(functions)).select("file", "block")
    units = facts.select(F.concat(F.lit("u-"), "file").alias("unit"), F.when(F.length("file") == 10, F.col("file")).otherwise(F.concat(F.lit("lib/"), F.substring_index("file", "/", -1))).alias("path"))
    return callgraph.facts_for_units(units, facts).select("unit", "path", F.length("block").alias("n"))


def _model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return relation(spark, sf_dir, "calls").select("role", n.alias("input_tokens"), F.floor(n / 4).alias("output_tokens"), F.when(F.col("seq") > 0, n - 1).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.token_totals(_model_calls(spark, sf_dir))


def usage_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.token_totals(_model_calls(spark, sf_dir), ["role"])


def slowest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "calls").select("unit", (F.col("conv_id") * 100 + F.col("seq")).alias("seq"), (F.col("n") / 16).alias("seconds"))
    return usage.slowest_units(rows)


def timeline_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.timeline_total(relation(spark, sf_dir, "calls").select((F.col("n") / 8).alias("seconds"), (F.col("seq") < 5).alias("ok")))


QUERIES = {f.__name__: f for f in (trigger_hits, trigger_topk, benchmark_passages, guide_match, coverage_matrix, coverage_problems, case_refs, suite_select, call_path_units, call_path_subsume, call_neighbours, call_fragments, facts_blocks, facts_for_units, usage_totals, usage_by_role, slowest_units, timeline_total)}

_TRIGGERS = "tr AS (SELECT * FROM (VALUES ('v-the', 'the was'), ('v-que', 'que la'), ('v-die', 'der die'), ('v-los', 'de los'), ('v-ing', 'ing the'), ('v-the', 'and the'), ('v-none', 'zzzz'), ('v-est', 'est le'), ('v-del', 'del'), ('v-von', 'von')) t(vuln_id, trig)), hits AS (SELECT DISTINCT doc_id AS diff_id, vuln_id FROM documents, tr WHERE contains(lower(upper(text)), trig))"
_IMPACT = "imp AS (SELECT * FROM (VALUES ('v-the', 2), ('v-que', 3), ('v-die', 0), ('v-los', 1), ('v-ing', 1), ('v-none', 3), ('v-est', 2), ('v-del', 2), ('v-von', 0)) t(vuln_id, rank))"
_MATRIX = f"""{cte('items')}, it AS (SELECT ref, min(kind) AS kind FROM items WHERE ref NOT LIKE '%5' GROUP BY ref),
us AS (SELECT ref, CASE WHEN size > 25 THEN 'diff_positive' ELSE 'diff_safe' END AS kind, 'public' AS prov FROM items WHERE id % 2 = 0 UNION ALL SELECT ref, CASE WHEN size > 40 THEN 'repository_planted' ELSE 'repository_safe' END, CASE WHEN id % 3 = 0 THEN 'private' ELSE 'public' END FROM items WHERE id % 2 = 1 AND id % 9 <> 0),
mx AS (SELECT it.ref, it.kind, count(*) FILTER (us.kind = 'diff_positive') AS diff_positive, count(*) FILTER (us.kind = 'diff_safe') AS diff_safe, count(*) FILTER (us.kind = 'repository_planted') AS repository_planted, count(*) FILTER (us.kind = 'repository_safe') AS repository_safe, count(*) FILTER (prov = 'public') AS public, count(*) FILTER (prov = 'private') AS private FROM it LEFT JOIN us ON us.ref = it.ref GROUP BY ALL)"""
_FN = f"""{cte('functions')}, fn0 AS (SELECT contract, fn, bool_or(flag = 'R') AS external_call, bool_or(line = 7) AS sends_eth, CAST(sum(quantity) AS INT) AS n FROM functions GROUP BY contract, fn),
fns AS (SELECT *, n % 10 <> 0 AS sized, n * 10 AS size FROM fn0), ld AS (SELECT contract, fn, lead(fn, 1) OVER w AS a, lead(fn, 2) OVER w AS b FROM fn0 WINDOW w AS (PARTITION BY contract ORDER BY fn)),
cl AS (SELECT contract, fn AS caller, a AS callee, CAST(0 AS BIGINT) AS seq FROM ld WHERE a IS NOT NULL UNION ALL SELECT contract, fn, b, 1 FROM ld WHERE b IS NOT NULL),
an AS (SELECT contract, fn AS anchor FROM fns WHERE sized AND external_call AND sends_eth),
nb0 AS (SELECT contract, anchor, anchor AS fn, 0 AS hop, CAST(0 AS BIGINT) AS seq FROM an UNION ALL SELECT an.contract, anchor, callee, 1, seq FROM an JOIN cl ON cl.contract = an.contract AND cl.caller = anchor UNION ALL SELECT an.contract, anchor, caller, 2, seq FROM an JOIN cl ON cl.contract = an.contract AND cl.callee = anchor),
nb1 AS (SELECT contract, anchor, fn, min(hop * 10 + seq) AS k FROM nb0 GROUP BY ALL),
nb AS (SELECT nb1.contract, anchor, nb1.fn, CAST(k // 10 AS INT) AS hop, CAST(k % 10 AS BIGINT) AS seq, fns.size FROM nb1 JOIN fns ON fns.contract = nb1.contract AND fns.fn = nb1.fn AND sized)"""
_UNITS = f"""{_FN}, ord AS (SELECT *, row_number() OVER (PARTITION BY contract, anchor ORDER BY hop, seq, fn) AS rn FROM nb),
fold AS (SELECT contract, anchor, rn, CAST(size AS BIGINT) AS total, [fn] AS fs FROM ord WHERE rn = 1 UNION ALL SELECT o.contract, o.anchor, o.rn, CASE WHEN f.total + o.size <= 2500 THEN f.total + o.size ELSE f.total END, CASE WHEN f.total + o.size <= 2500 THEN list_append(f.fs, o.fn) ELSE f.fs END FROM fold f JOIN ord o ON o.contract = f.contract AND o.anchor = f.anchor AND o.rn = f.rn + 1),
un AS (SELECT contract, anchor, list_sort(arg_max(fs, rn)) AS fs, arg_max(total, rn) AS chars FROM fold GROUP BY contract, anchor)"""

_BLOCKS = f"""{_FN}, ce AS (SELECT contract, caller AS fn, array_to_string(list_sort(list_distinct(list(callee))), ', ') AS cs FROM cl GROUP BY ALL),
ln AS (SELECT f.contract, f.fn, '- ' || f.fn || ' public' || CASE WHEN external_call THEN ' external-call' ELSE '' END || CASE WHEN sends_eth THEN ' sends-eth' ELSE '' END || coalesce(' calls ' || cs, '') AS line FROM fns f LEFT JOIN ce ON ce.contract = f.contract AND ce.fn = f.fn),
bk AS (SELECT contract, 'src/' || contract || '.sol' AS file, string_agg(line, chr(10) ORDER BY fn) AS block FROM ln GROUP BY contract)"""

SQL = {
    "trigger_hits": f"WITH {_TRIGGERS} SELECT diff_id, vuln_id FROM hits",
    "trigger_topk": f"WITH {_TRIGGERS}, {_IMPACT}, r AS (SELECT diff_id, vuln_id, rank, row_number() OVER (PARTITION BY diff_id ORDER BY rank DESC, vuln_id DESC) AS place FROM hits JOIN imp USING (vuln_id)) SELECT diff_id, CAST(place AS INT) AS place, vuln_id, CAST(rank AS INT) AS rank FROM r WHERE place <= 3",
    "benchmark_passages": "SELECT doc_id, item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)",
    "guide_match": f"WITH {cte('files')} SELECT CAST(seq AS INT) AS seq, id FROM (VALUES (0, 'python', (SELECT bool_or(path LIKE 'src1%/%.py') FROM files)), (2, 'flask', (SELECT bool_or(contains(lower(text), 'and')) FROM files WHERE path LIKE '%.lock')), (3, 'oauth', (SELECT bool_or(contains(lower(text), 'the was')) FROM files))) t(seq, id, ok) WHERE ok",
    "coverage_matrix": f"WITH {_MATRIX} SELECT * FROM mx",
    "coverage_problems": f"WITH {_MATRIX}, en AS (SELECT 'e' || CAST(id AS VARCHAR) AS id, ref, id % 9 = 0 AS bare FROM items) SELECT 'missing-positive' AS kind, ref, '' AS detail FROM mx WHERE kind = 'vulnerability' AND diff_positive = 0 UNION ALL SELECT 'missing-safe', ref, '' FROM mx WHERE kind = 'vulnerability' AND diff_safe = 0 UNION ALL SELECT 'missing-repository-target', ref, '' FROM mx WHERE kind = 'vulnerability' AND repository_planted = 0 UNION ALL SELECT 'unresolved-reference', ref, 'entry b ' || id FROM en WHERE NOT bare AND ref NOT IN (SELECT ref FROM mx) UNION ALL SELECT 'unresolved-reference', ref, 'manifest b' FROM (VALUES ('vuln:brand-11'), ('vuln:nowhere')) t(ref) WHERE ref NOT IN (SELECT ref FROM mx) UNION ALL SELECT 'entry-without-knowledge', id, '' FROM en WHERE bare",
    "case_refs": f"WITH {cte('items')} SELECT id, CASE id % 3 WHEN 0 THEN ref WHEN 1 THEN 'vuln:' || regexp_replace(tag, '[\\s_]+', '-', 'g') ELSE '' END AS refs FROM items",
    "suite_select": f"WITH {cte('items')} SELECT id, 'some' AS suite FROM items WHERE kind = 'guide' AND (list_contains(string_split(tag, ' '), 'small') OR list_contains(string_split(tag, ' '), 'promo')) UNION ALL SELECT id, 'all tags' FROM items WHERE kind = 'vulnerability'",
    "call_neighbours": f"WITH {_FN} SELECT contract, anchor, fn, hop, seq, size FROM nb",
    "call_path_units": f"WITH RECURSIVE {_UNITS} SELECT contract, anchor, 'src/' || contract || '.sol#' || contract || '.' || split_part(anchor, '(', 1) AS name, array_to_string(fs, ',') AS fns, chars FROM un",
    "call_path_subsume": f"WITH RECURSIVE {_UNITS}, ds AS (SELECT fs, min(contract || ' ' || anchor) AS k FROM un GROUP BY fs) SELECT contract, anchor, array_to_string(un.fs, ',') AS fns FROM un JOIN ds ON ds.fs = un.fs AND ds.k = contract || ' ' || anchor WHERE NOT EXISTS (SELECT 1 FROM ds o WHERE len(o.fs) > len(un.fs) AND list_has_all(o.fs, un.fs))",
    "usage_totals": f"WITH {cte('calls')} SELECT count(*) AS calls, CAST(sum(n) AS BIGINT) AS input_tokens, CAST(sum(n // 4) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN seq > 0 THEN n - 1 END) AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens FROM calls",
    "usage_by_role": f"WITH {cte('calls')} SELECT role, count(*) AS calls, CAST(sum(n) AS BIGINT) AS input_tokens, CAST(sum(n // 4) AS BIGINT) AS output_tokens, CAST(coalesce(sum(CASE WHEN seq > 0 THEN n - 1 END), 0) AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens FROM calls GROUP BY role",
    "slowest_units": f"WITH {cte('calls')} SELECT unit, round_even(sum(round_even(n / 16, 1)), 1) AS seconds, count(*) AS steps, min(conv_id * 100 + seq) AS seq FROM calls GROUP BY unit ORDER BY seconds DESC, seq LIMIT 5",
    "timeline_total": f"WITH {cte('calls')} SELECT count(*) AS stages, round_even(sum(n / 8), 1) AS seconds, count(*) FILTER (seq >= 5) AS failed FROM calls",
    "call_fragments": f"WITH RECURSIVE {_UNITS}, x AS (SELECT contract, anchor, unnest(fs) AS fn FROM un) SELECT x.contract, anchor, 'src/' || x.contract || '.sol' AS file, CAST(n * 7 % 1000 AS INT) AS \"start\", CAST(n * 7 % 1000 + n * 10 AS INT) AS \"end\" FROM x JOIN fns ON fns.contract = x.contract AND fns.fn = x.fn",
    "facts_blocks": f"WITH {_BLOCKS} SELECT contract, file, sha256(block) AS digest FROM bk",
    "facts_for_units": f"WITH {_BLOCKS} SELECT 'u-' || file AS unit, CASE WHEN length(file) = 10 THEN file ELSE 'lib/' || split_part(file, '/', 2) END AS path, CAST(length(block) AS INT) AS n FROM bk",
}
