"""Queries on sources and stored state: notes, keys, cases, payloads, checkpoints, settings, responses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import jsonscan, location, replies
from siftstone.operators import chunk, filters, gate, select, union, workspace
from siftstone.queries.adapters import cte, dealt, relation
from siftstone.queries.findings import _FOLDED, _candidates
from siftstone.session import shared_folder
from siftstone.sources import checkpoint, files, keys, notes, payload, rules


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _join(c: str):
    return F.array_join(c, ",").alias(c)


def readable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some contents aren't UTF-8, some are too large."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.when(F.col("lang") == "de", F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary")).alias("content"), (F.col("n_chars") * 500).cast("long").alias("length"))
    return rows.select("doc_id", F.sha2(files.readable_text(), 256).alias("digest"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_rows(relation(spark, sf_dir, "files").select("path", "text")).select("path", "size", F.sha2("text", 256).alias("digest"))


def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "files").select(F.substring_index("path", "/", -1).alias("path"), "text")
    return files.manifest_text(rows, ["doc_3.md", "doc_12.py", "doc_7.go"]).select(F.sha2("text", 256).alias("digest"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge note for each part."""
    kind = F.element_at(F.array(*map(F.lit, ("language", "framework", "protocol", "vulnerability"))), (F.col("p_size") % 4 + 1).cast("int"))
    head = F.concat(F.lit("---\nkind: "), kind, F.lit("\ntitle: "), "p_name", F.lit("\nimpact: high\ntriggers: ["), F.lower("p_type"), F.lit(", \"b c\"]\naliases: "), F.lower("p_brand"), F.lit("\ndetect_files: *."), F.lower("p_type"), F.lit("\ndetect_manifest: "), "p_brand", F.lit("\n---\n"))
    text = F.when(F.col("p_size") > 45, F.lit("plain\n")).otherwise(F.concat(head, F.lit("\nAbout "), "p_name", F.lit("\n")))
    return _part(spark, sf_dir).select(F.when(F.col("p_size") == 1, "index").otherwise(F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).alias("name"), text.alias("text"))


def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.frontmatter(_notes(spark, sf_dir))
    value = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return rows.select("name", value("kind"), value("title"), value("impact"), "body")


def knowledge_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.knowledge_docs(_notes(spark, sf_dir)).select("id", "kind", "title", "impact", _join("triggers"), _join("aliases"), _join("tags"), "body")


def guide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.guides(_notes(spark, sf_dir))
    return rows.select("seq", "id", "kind")


def guide_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.guide_signals(_notes(spark, sf_dir))


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON reply for each event, an object or a bare list."""
    rows = relation(spark, sf_dir, "candidates")
    item = F.struct("title", "category", "endpoint", "file", "line", F.lit("see lib/x.go:9").alias("description"))
    bare = F.to_json(F.array(item))
    text = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"findings": '), bare, F.lit("}"))).otherwise(bare)
    found = notes.findings_json(rows.select(F.col("seq").cast("string").alias("name"), text.alias("text")), rules.DEFAULT["source_ext"])
    return found.select("name", "category", _join("files"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def answer_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key as JSON for each brand, with entries in all the forms that they may have."""
    p = _part(spark, sf_dir)
    n = F.col("p_partkey").cast("string")
    entry = F.struct(F.concat(F.lit("e"), F.lpad(n, 9, "0")).alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("GET /"), n)).alias("entry"), F.when(F.col("p_size") % 2 == 1, F.concat(n, F.lit(".py"))).alias("file"), F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).alias("category"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" Fn_"), n)).alias("symbol"))
    rows = p.groupBy(F.col("p_brand").alias("target")).agg(F.array_sort(F.collect_list(F.when(F.col("p_size") <= 25, entry))).alias("planted"), F.array_sort(F.collect_list(F.when(F.col("p_size") > 25, entry))).alias("safe"))
    return keys.answer_keys(rows.select("target", F.to_json(F.struct("planted", "safe")).alias("text"))).select("target", "kind", "seq", "id", "entry", _join("files"), "category", _join("symbols"))


def diff_case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir)
    case = F.struct(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("+"), "p_name").alias("diff"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).alias("category"), F.when(F.col("p_size") % 3 == 0, F.array(F.lower("p_brand"))).alias("tags"), F.when(F.col("p_size") % 7 == 0, "evm").alias("domain"))
    return keys.cases(p.select(F.to_json(case).alias("text"))).select("name", "diff", "category", _join("knowledge"), _join("tags"), "domain")


def benchmarks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("own").alias("root"))
    other = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("other").alias("root"))
    return keys.merged_benchmarks([(0, own, False), (1, other, True)])


def suite_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite that each nation asks for: its region."""
    suites = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), (F.col("c_nationkey") % 5 + 1).cast("int")).alias("suite"))
    return keys.suites_of(asked, suites).select("c_custkey", "name", "k")


def knowledge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of knowledge, some of them twice by the same path."""
    p = _part(spark, sf_dir)
    rows = p.select(F.concat(F.lit("vuln:"), F.lower("p_brand")).alias("ref"), F.lit("vulnerability").alias("kind"), F.concat(F.lower("p_brand"), F.lit(".md")).alias("path"))
    return keys.knowledge_items(rows)


def checkpoint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _place(spark)
    checkpoint.save(union.fold(_candidates(spark, sf_dir)), place)
    return checkpoint.load(spark, place, checkpoint.UNION).select("key", "seq", "title", "severity", "evidence", "status", _join("found_by"))


def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, some lines of the first cut off."""
    calls, place = relation(spark, sf_dir, "calls"), _place(spark)
    rows = calls.select((F.col("conv_id") * 100 + F.col("seq")).cast("int").alias("seq"), F.col("role").alias("stage"), (F.col("n") / 8).alias("seconds"), (F.col("seq") < 5).alias("ok"))
    line = F.to_json(F.struct("seq", "stage", "seconds", "ok"))
    rows.where("stage = 'user'").select(F.when(F.col("seconds") > 20, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.mode("append").text(place)
    checkpoint.append_timeline(rows.where("stage <> 'user'"), place)
    return checkpoint.load_timeline(spark, place).select("seq", "stage", "seconds", "ok")


def prior_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace for each customer, its orders' lines as units, and candidates of those whose orders are large."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("workspace"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("workspace"), "o_orderstatus", "o_totalprice")
    units = orders.select("workspace", F.when(F.col("o_orderstatus") == "P", "reviewed").otherwise("open").alias("status"))
    return gate.prior_runs(c, units, orders.where("o_totalprice > 400000").select("workspace"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each supplier, in the three shapes."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = F.col("s_suppkey").cast("string")
    plain = F.concat(F.lit("contract C"), n, F.lit(" {}"))
    mapped = F.concat(F.lit('{"src\\\\a'), n, F.lit('.sol": "A", "b.sol": {"content": "B'), n, F.lit('"}}'))
    standard = F.concat(F.lit('{{"language": "Solidity", "sources": {"lib/c.sol": {"content": "C'), n, F.lit('"}}}}'))
    code = F.when(F.col("s_suppkey") % 3 == 0, plain).when(F.col("s_suppkey") % 3 == 1, mapped).otherwise(standard)
    return s.select(n.alias("address"), F.concat(F.lit("C"), n).alias("contract_name"), code.alias("source_code"), F.when(F.col("s_nationkey") % 3 == 0, "1").when(F.col("s_nationkey") % 3 == 1, "0").otherwise("?").alias("flag"), F.when(F.col("s_nationkey") % 4 == 0, "none").otherwise(F.col("s_nationkey").cast("string")).alias("runs"))


def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.reconstructed(_payloads(spark, sf_dir))


def payload_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explorer responses into metadata and sources."""
    rows = _payloads(spark, sf_dir)
    entry = F.struct(F.col("source_code").alias("SourceCode"), F.col("contract_name").alias("ContractName"), F.lit("v0.8").alias("CompilerVersion"), F.col("flag").alias("OptimizationUsed"), F.col("runs").alias("Runs"), F.lit("").alias("EVMVersion"), F.lit("0").alias("Proxy"), F.lit("").alias("Implementation"))
    responses = rows.select("address", F.to_json(F.struct(F.lit("1").alias("status"), F.array(entry).alias("result"))).alias("payload"))
    meta = payload.metadata(payload.checked(responses))
    return meta.select("address", "contract_name", "compiler_version", "optimization_used", "runs", "proxy")


def provenance_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = payload_checked(spark, sf_dir)
    return payload.provenance_rows(meta)


def target_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.target_note(provenance_fields(spark, sf_dir))


def provenance_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of each customer's source, all of it empty for some."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    odd = lambda k, x: F.when(F.col("c_nationkey") % k > 0, x)
    meta = c.select("c_custkey", F.lit("0x1").alias("address"), odd(2, F.col("c_name")).alias("contract_name"), F.coalesce(odd(3, F.col("c_mktsegment")), F.lit("")).alias("evm_version"), odd(5, F.col("c_nationkey")).alias("runs"))
    return meta.select("c_custkey", payload.is_blank(meta.drop("c_custkey")).alias("missing"))


def chain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain that each customer names, by its id."""
    named = F.element_at(F.array(*map(F.lit, payload.CHAINS)), (F.col("c_nationkey") % len(payload.CHAINS) + 1).cast("int"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("chain", named)
    return c.select("c_custkey", "chain", payload.chain_of(F.col("chain")).alias("id"))


def env_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file for each customer."""
    c = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    text = F.concat(F.lit("# note\nexport NAME = '"), "c_name", F.lit("'\nnot a pair\n=x\nSEGMENT="), "c_mktsegment", F.lit("\nA=1\nQ=\""), F.col("c_nationkey").cast("string"), F.lit("\nA=b=c\n"))
    return c.select("c_custkey", F.inline(replies.env_pairs(text)))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three shapes, for each turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").alias("n"), F.concat(F.lit("reply "), "role").alias("said"))
    shape = F.element_at(F.array(*map(F.lit, ("messages", "chat", "responses"))), (F.col("conv_id") % 3 + 1).cast("int"))
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("said").alias("text")), F.struct(F.lit("x").alias("type"), F.lit("!").alias("text"))))
    n = F.col("n").cast("string")
    usage = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": "7", "cache_read_input_tokens": 5, "cache_creation_input_tokens": 2.0}')))
    usage = usage.when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": 9, "prompt_tokens_details": {"cached_tokens": 40}}'))).otherwise(F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": 3}')))
    content = F.when(F.col("turn") % 2 == 0, block).otherwise(F.concat(F.lit('"'), "said", F.lit('"')))
    body = F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"choices": [{"message": {"content": '), content, F.lit('}}], "usage": '), usage, F.lit("}"))).otherwise(F.concat(F.lit('{"content": '), content, F.lit(', "result": "done", "usage": '), usage, F.lit("}")))
    return t.select("conv_id", "turn", "role", "n", shape.alias("shape"), F.when(F.col("turn") == 6, F.lit(" not json ")).otherwise(body).alias("response"))


def usage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("conv_id", "turn", replies.token_usage(F.col("response"), F.col("shape")).alias("u")).select("conv_id", "turn", "u.*")


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir)
    return rows.select("conv_id", "turn", replies.reply_text(F.col("response"), F.when(F.col("shape") == "responses", "envelope").otherwise(F.col("shape"))).alias("text"))


def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source for each part, with braces or by indentation."""
    n = F.col("p_partkey").cast("string")
    braces = F.concat(F.lit("// x\nfunction f"), n, F.lit("() {\n  if (a) { b }\n}\n"), F.repeat(F.lit("y\n"), F.col("p_size")))
    indented = F.concat(F.repeat(F.lit("import x\n"), F.col("p_size")), F.lit("def f"), n, F.lit("(a):\n    if a:\n        b\n\nz = 1\n"))
    rows = _part(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") % 2 == 0, braces).otherwise(indented).alias("text"), F.when(F.col("p_size") % 10 == 0, "none").otherwise(F.concat(F.lit("f"), n)).alias("symbol"))
    return rows.select("p_partkey", jsonscan.symbol_lines("text", "symbol").alias("s")).select("p_partkey", "s.first", "s.last")


def guide_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("seq"), F.array(F.lower("p_type"), "p_brand", F.lower("p_type")).alias("patterns"))
    return select.flattened(rows, "patterns")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("intro\n| Module | Entry |\n|---|:-:|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n|"), F.lower("p_type"), F.lit("|x|\nend"))
    rows = _part(spark, sf_dir).select("p_partkey", F.posexplode(location.table_rows(text)).alias("i", "cells"))
    return rows.select("p_partkey", "i", F.array_join("cells", "/").alias("cells"))


def fence_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("see\n```sol\n"), "p_name", F.lit("\n```\nand ```x```"))).otherwise(F.col("p_name"))
    return _part(spark, sf_dir).select("p_partkey", location.code_fence(text).alias("body"))


def extension_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sampled_kinds(relation(spark, sf_dir, "files"), rules.detection_extensions(rules.DEFAULT))


def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each folder of a language, by all its files and by its contracts and notes."""
    rows = relation(spark, sf_dir, "files").withColumn("folder", F.regexp_extract("path", "^([^/]*/[^/]*)/", 1))
    some = rows.where("path like '%.sol' or path like '%.md'")
    parts = (filters.domain_of(r, group=["folder"]).select(F.lit(asked).alias("asked"), "folder", "domain") for asked, r in (("all", rows), ("some", some)))
    return next(parts).unionByName(next(parts))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "files")
    some = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    review = chunk.review_prompt(F.col("path"), classes=some, rubric=F.lit("high: bad"))
    return rows.select("doc_id", review.alias("review"), chunk.seat_prompt("judge", F.col("path"), some, F.col("source")).alias("judge"), F.sha2(chunk.skeptic_prompt(F.col("path"), F.col("text")), 256).alias("skeptic"))


def class_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = notes.knowledge_docs(_notes(spark, sf_dir))
    stack = workspace.stack_note(notes.guides(_notes(spark, sf_dir)).where("kind in ('language', 'protocol')"))
    return stack.select(F.lit("stack").alias("note"), F.sha2("text", 256).alias("digest")).unionByName(workspace.class_note(docs).select(F.lit("classes").alias("note"), F.sha2("text", 256).alias("digest")))


def entrypoint_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "files").select("path")
    full = workspace.entrypoint_note(rows.where("path like '%.py'"), rows.where("path like '%.go'"), "a library")
    none = workspace.entrypoint_note(rows.limit(0), rows.limit(0))
    return full.unionByName(none).select(F.sha2("text", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (readable_texts, listed_files, manifest_text, frontmatter_fields, knowledge_notes, guide_order, guide_signal_rows, json_reports, answer_key_rows, diff_case_rows, benchmarks_merged, suite_row, knowledge_scan, checkpoint_union, timeline_rows, prior_runs, payload_files, payload_checked, provenance_fields, target_notes, provenance_state, chain_ids, env_settings, usage_fields, reply_texts, symbol_spans, guide_lists, table_cells, fence_bodies, extension_list, domain_lookup, prompt_texts, class_notes, entrypoint_notes)}

_KIND = "CASE p_size % 4 WHEN 0 THEN 'language' WHEN 1 THEN 'framework' WHEN 2 THEN 'protocol' ELSE 'vulnerability' END"
_NOTES = f"nt AS (SELECT CASE WHEN p_size = 1 THEN 'index' ELSE 'n' || CAST(p_partkey AS VARCHAR) END AS name, p_size <= 45 AS full_, {_KIND} AS kind, p_name, lower(p_type) AS t, p_brand FROM part)"
_BODY = "CASE WHEN full_ THEN 'About ' || p_name ELSE 'plain' END"
_GUIDES = f"gd AS (SELECT row_number() OVER (ORDER BY CASE kind WHEN 'language' THEN 0 WHEN 'framework' THEN 1 WHEN 'protocol' THEN 2 ELSE 3 END, name) - 1 AS seq, name AS id, kind, {_BODY} AS body FROM (SELECT name, CASE WHEN full_ THEN kind ELSE '' END AS kind, full_, p_name FROM nt WHERE name <> 'index'))"
_PAYLOAD = "pl AS (SELECT CAST(s_suppkey AS VARCHAR) AS n, s_suppkey % 3 AS k, CASE s_nationkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE '?' END AS flag, CASE WHEN s_nationkey % 4 = 0 THEN 'none' ELSE CAST(s_nationkey AS VARCHAR) END AS runs FROM supplier)"
_META = "mt AS (SELECT n AS address, 'C' || n AS contract_name, 'v0.8' AS compiler_version, CASE flag WHEN '1' THEN true WHEN '0' THEN false END AS optimization_used, try_cast(runs AS INT) AS runs, false AS proxy FROM pl)"
_FIELDS = "fi AS (SELECT address, 'contract_name' AS field, contract_name AS value FROM mt UNION ALL SELECT address, 'compiler_version', compiler_version FROM mt UNION ALL SELECT address, 'optimization_used', CAST(optimization_used AS VARCHAR) FROM mt WHERE optimization_used IS NOT NULL UNION ALL SELECT address, 'runs', CAST(runs AS VARCHAR) FROM mt WHERE runs IS NOT NULL UNION ALL SELECT address, 'proxy', 'false' FROM mt)"
_REVIEW = "'Review this change for defects. Reply with JSON: a list ``findings``, empty if there is none.'"
_NL = "chr(10) || chr(10)"
_NUM = "array_to_string(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(string_split(text, chr(10))) AS VARCHAR)) AS INT), ' ') || ' | ' || string_split(text, chr(10))[i]), chr(10))"

SQL = {
    "readable_texts": "SELECT doc_id, sha256(CASE WHEN lang = 'de' OR n_chars * 500 > 2000000 THEN '' ELSE text END) AS digest FROM documents",
    "listed_files": f"WITH {cte('files')} SELECT path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest FROM files",
    "manifest_text": f"WITH {cte('files')}, r AS (SELECT list_last(string_split(path, '/')) AS path, text FROM files) SELECT sha256(string_agg(text, chr(10) ORDER BY path, text)) AS digest FROM r WHERE path IN ('doc_3.md', 'doc_12.py', 'doc_7.go')",
    "frontmatter_fields": f"WITH {_NOTES} SELECT name, CASE WHEN full_ THEN kind END AS kind, CASE WHEN full_ THEN p_name END AS title, CASE WHEN full_ THEN 'high' END AS impact, CASE WHEN full_ THEN 'About ' || p_name || chr(10) ELSE 'plain' || chr(10) END AS body FROM nt",
    "knowledge_notes": f"WITH {_NOTES} SELECT name AS id, CASE WHEN full_ THEN kind ELSE '' END AS kind, CASE WHEN full_ THEN p_name ELSE '' END AS title, CASE WHEN full_ THEN 'high' ELSE '' END AS impact, CASE WHEN full_ THEN t || ',b c' ELSE '' END AS triggers, CASE WHEN full_ THEN lower(p_brand) ELSE '' END AS aliases, '' AS tags, {_BODY} AS body FROM nt WHERE name <> 'index'",
    "guide_order": f"WITH {_NOTES}, {_GUIDES} SELECT CAST(seq AS INT) AS seq, id, kind FROM gd",
    "guide_signal_rows": f"WITH {_NOTES} SELECT name AS guide_id, 'file' AS signal, '*.' || t AS pattern FROM nt WHERE full_ UNION ALL SELECT name, 'manifest', lower(p_brand) FROM nt WHERE full_",
    "json_reports": f"WITH {cte('candidates')} SELECT CAST(seq AS VARCHAR) || '#0' AS name, CASE category WHEN 'SQL_Injection' THEN 'sql-injection' WHEN 'missing auth' THEN 'missing-authorization' ELSE category END AS category, array_to_string(list_sort(list_distinct(['lib/x.go', file])), ',') AS files, array_to_string(list_sort(list_distinct(CASE WHEN line IS NULL THEN [9] ELSE [9, line] END)), ',') AS lines FROM candidates",
    "answer_key_rows": "WITH e AS (SELECT p_brand AS target, CASE WHEN p_size <= 25 THEN 'planted' ELSE 'safe' END AS kind, p_partkey, p_size, p_type, 'e' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id FROM part) SELECT target, kind, CAST(row_number() OVER (PARTITION BY target, kind ORDER BY id) - 1 AS INT) AS seq, id, CASE WHEN p_size % 2 = 0 THEN 'GET /' || CAST(p_partkey AS VARCHAR) ELSE '' END AS entry, CASE WHEN p_size % 2 = 1 THEN CAST(p_partkey AS VARCHAR) || '.py' ELSE '' END AS files, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE '' END AS category, CASE WHEN p_size % 5 = 0 THEN 'fn_' || CAST(p_partkey AS VARCHAR) ELSE '' END AS symbols FROM e",
    "diff_case_rows": "SELECT CAST(p_partkey AS VARCHAR) AS name, '+' || p_name AS diff, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE '' END AS category, '' AS knowledge, CASE WHEN p_size % 3 = 0 THEN lower(p_brand) ELSE '' END AS tags, CASE WHEN p_size % 7 = 0 THEN 'evm' ELSE 'web' END AS domain FROM part",
    "benchmarks_merged": "SELECT coalesce(CAST(s_suppkey AS VARCHAR), CAST(p_partkey AS VARCHAR)) AS id, coalesce(s_name, p_name) AS name, CASE WHEN s_suppkey IS NULL THEN 'own' ELSE 'other' END AS root FROM part FULL JOIN supplier ON s_suppkey = p_partkey",
    "suite_row": "SELECT c_custkey, r_name AS name, r_regionkey AS k FROM customer JOIN region ON r_name = ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][c_nationkey % 5 + 1]",
    "knowledge_scan": "SELECT DISTINCT 'vuln:' || lower(p_brand) AS ref, 'vulnerability' AS kind FROM part",
    "checkpoint_union": f"WITH {_FOLDED} SELECT key, seq, title, severity, evidence, status, found_by FROM folded",
    "timeline_rows": f"WITH {cte('calls')} SELECT CAST(conv_id * 100 + seq AS INT) AS seq, role AS stage, n / 8 AS seconds, seq < 5 AS ok FROM calls WHERE role <> 'user' OR n / 8 <= 20",
    "prior_runs": "SELECT c_custkey AS workspace, coalesce(bool_or(o_orderstatus = 'P' OR o_totalprice > 400000), false) AS prior FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "payload_files": f"WITH {_PAYLOAD} SELECT n AS address, 'C' || n || '.sol' AS path, 'contract C' || n || ' {{}}' AS text FROM pl WHERE k = 0 UNION ALL SELECT n, 'src/a' || n || '.sol', 'A' FROM pl WHERE k = 1 UNION ALL SELECT n, 'b.sol', 'B' || n FROM pl WHERE k = 1 UNION ALL SELECT n, 'lib/c.sol', 'C' || n FROM pl WHERE k = 2",
    "payload_checked": f"WITH {_PAYLOAD}, {_META} SELECT * FROM mt",
    "provenance_fields": f"WITH {_PAYLOAD}, {_META}, {_FIELDS} SELECT * FROM fi",
    "target_notes": f"WITH {_PAYLOAD}, {_META}, {_FIELDS} SELECT address, '## Target' || {_NL} || string_agg('- ' || field || ': ' || value, chr(10) ORDER BY field, value) AS text FROM fi GROUP BY address",
    "provenance_state": "SELECT c_custkey, c_nationkey % 2 = 0 AND (c_nationkey % 3 = 0 OR c_mktsegment = '') AND c_nationkey % 5 = 0 AS missing FROM customer",
    "chain_ids": "SELECT c_custkey, ['ethereum', 'bsc', 'polygon', 'arbitrum'][c_nationkey % 4 + 1] AS chain, [1, 56, 137, 42161][c_nationkey % 4 + 1] AS id FROM customer",
    "env_settings": "SELECT c_custkey, 'NAME' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'SEGMENT', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'Q', '\"' || CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'A', 'b=c' FROM customer",
    "usage_fields": "WITH t AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n, CASE WHEN turn = 6 THEN 3 ELSE conv_id % 3 END AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 0 THEN n WHEN 1 THEN greatest(n - 40, 0) WHEN 2 THEN n ELSE 0 END AS input_tokens, CAST(CASE k WHEN 1 THEN 9 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS output_tokens, CAST(CASE k WHEN 0 THEN 5 WHEN 1 THEN 40 ELSE 0 END AS BIGINT) AS cache_read_tokens, CAST(CASE k WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS cache_write_tokens FROM t",
    "reply_texts": "SELECT conv_id, turn, CASE WHEN turn = 6 AND conv_id % 3 < 2 THEN '' WHEN turn = 6 THEN 'not json' WHEN conv_id % 3 = 2 THEN 'done' ELSE 'reply ' || role || CASE WHEN turn % 2 = 0 THEN '!' ELSE '' END END AS text FROM conversations",
    "symbol_spans": "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 2 ELSE p_size + 1 END AS first, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 4 ELSE p_size + 4 END AS last FROM part",
    "guide_lists": "SELECT DISTINCT lower(p_type) AS value FROM part UNION SELECT DISTINCT p_brand FROM part",
    "table_cells": "SELECT p_partkey, 0 AS i, p_name || '/' || p_brand AS cells FROM part UNION ALL SELECT p_partkey, 1, lower(p_type) || '/x' FROM part",
    "fence_bodies": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) ELSE p_name END AS body FROM part",
    "extension_list": f"WITH {cte('files')}, e AS (SELECT unnest({sorted({*rules.DEFAULT['source_ext'], *rules.DEFAULT['config_ext']})}) AS extension) SELECT extension, count(path) AS n FROM e LEFT JOIN files ON ends_with(path, extension) GROUP BY extension",
    "domain_lookup": f"WITH {cte('files')}, r AS (SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS folder, path, ends_with(path, '.sol') AS sol, ends_with(path, '.md') AS md FROM files), a AS (SELECT 'all' AS asked, * FROM r UNION ALL SELECT 'some', * FROM r WHERE sol OR md) SELECT asked, folder, CASE WHEN count(*) FILTER (sol) > 0 AND count(*) FILTER (sol) >= count(*) FILTER (NOT sol) THEN 'evm' ELSE 'web' END AS domain FROM a GROUP BY ALL",
    "prompt_texts": f"WITH {cte('files')}, s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS cls FROM files) SELECT doc_id, {_REVIEW} || CASE WHEN cls <> '' THEN {_NL} || 'Classes:' || chr(10) || cls ELSE '' END || {_NL} || 'Change:' || chr(10) || path || {_NL} || 'Severities:' || chr(10) || 'high: bad' AS review, 'Decide which findings stay, and say whether anything is left to investigate.' || {_NL} || 'Change:' || chr(10) || path || CASE WHEN cls <> '' THEN {_NL} || 'So far:' || chr(10) || cls ELSE '' END || {_NL} || 'So far:' || chr(10) || source AS judge, sha256('Is this finding real? Reply with JSON: ``real``, ``reason`` and ``controls``, the files that prevent it.' || {_NL} || 'Finding:' || chr(10) || path || {_NL} || 'Code:' || chr(10) || {_NUM}) AS skeptic FROM s",
    "class_notes": f"WITH {_NOTES}, {_GUIDES} SELECT 'stack' AS note, sha256('# Stack' || {_NL} || 'Languages: ' || string_agg(id, ', ' ORDER BY seq) FILTER (kind = 'language') || chr(10) || 'Frameworks: -' || chr(10) || 'Protocols: ' || string_agg(id, ', ' ORDER BY seq) FILTER (kind = 'protocol') || string_agg({_NL} || '---' || {_NL} || body, '' ORDER BY seq)) AS digest FROM gd WHERE kind IN ('language', 'protocol') UNION ALL SELECT 'classes', sha256('# Classes' || {_NL} || string_agg('---' || {_NL} || body, chr(10) ORDER BY id)) FROM gd",
    "entrypoint_notes": f"WITH {cte('files')} SELECT sha256('# Entry points' || {_NL} || 'Note: a library' || {_NL} || '## May define entry points' || {_NL} || string_agg('- ' || path, chr(10) ORDER BY path) FILTER (path LIKE '%.py') || {_NL} || '## To trace into' || {_NL} || string_agg('- ' || path, chr(10) ORDER BY path) FILTER (path LIKE '%.go')) AS digest FROM files UNION ALL SELECT sha256('# Entry points' || {_NL} || '## May define entry points' || {_NL} || '(none)' || {_NL} || '## To trace into' || {_NL} || '(none)')",
}
