"""Queries on files and places: classes of paths, inventories, resolution, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import location
from siftstone.functions.text import basename, suffix
from siftstone.operators import filters, gate, report, resolve
from siftstone.queries.adapters import cte, relation
from siftstone.sources import files as sources
from siftstone.sources.rules import DEFAULT

GLOBS, MARKERS, PATTERNS = ["src1*/en/*.go", "*/de/doc_?.ts"], ["the was", "que la"], ["^[A-Z]", "^zzz"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "files")


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("path", filters.is_test_path(p, DEFAULT).alias("test"), filters.is_noise(p, DEFAULT).alias("noise"), filters.is_source(p, DEFAULT).alias("source"), suffix(p).alias("suffix"), basename(p).alias("name"))


def noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 19 != 0, F.col("path")).alias("path"))
    kept, skipped = filters.strip_noise(rows, DEFAULT)
    return kept.select("doc_id", F.lit("kept").alias("part")).unionByName(skipped.select("doc_id", F.lit("skipped").alias("part")))


def entrypoint_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(filters.is_entrypoint(F.col("path"), F.col("text"), DEFAULT, GLOBS, MARKERS)).select("path")


def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(filters.is_public_api(F.col("path"), F.col("text"), DEFAULT, PATTERNS)).select("path")


def logic_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(filters.is_logic_layer(F.col("path"), DEFAULT, ["*/fr/*.py", "src3/*"])).select("path")


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(filters.in_inventory(F.col("path"), DEFAULT)).select("path", "size")


def domain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark, sf_dir).where(filters.is_source(F.col("path"), DEFAULT)).withColumn("dir", F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")))
    return filters.domain_of(own, group=["dir"])


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), "url")).when(F.col("page_id") % 4 == 2, F.concat(F.lit("a/../"), "url")).otherwise(F.concat(F.lit("a..b/"), "url"))
    return pages.select("page_id", location.is_unsafe(path).alias("unsafe"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to files: whole paths, names alone (some shared), and paths that don't exist."""
    name = basename(F.col("path"))
    ref = F.when(F.col("doc_id") % 5 == 0, F.col("path")).when(F.col("doc_id") % 5 == 1, name).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("../"), "path")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("x/"), name)).otherwise("missing.py")
    return _files(spark, sf_dir).select("doc_id", ref.alias("file"))


def resolve_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path")
    shared = files.where("path like '%1.py'").select(F.concat(F.lit("copy/"), basename(F.col("path"))).alias("path"))
    return resolve.resolve_paths(_refs(spark, sf_dir), files.unionByName(shared)).select("doc_id", "file", "resolved")


def basename_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.basename_index(_files(spark, sf_dir).select(F.regexp_replace("path", "doc_[0-9]*([0-9])", "doc_$1").alias("path")))


def verify_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.verify_text(_refs(spark, sf_dir), _files(spark, sf_dir)).select("doc_id", "resolved", F.length("code").alias("n"))


def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.contained_paths(_refs(spark, sf_dir), _files(spark, sf_dir)).select("doc_id", "file")


def coverage_unowned(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = _files(spark, sf_dir).where(filters.in_inventory(F.col("path"), DEFAULT)).select("path")
    artifacts = _files(spark, sf_dir).where("path not like '%/de/%'").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- Files: `"), "path", F.lit(":12`, x"))).otherwise(F.concat(F.lit("see-"), "path", F.lit("."))).alias("text"))
    return gate.unowned(inventory, artifacts)


def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    units = files.select(F.col("path").alias("unit"), F.when(F.col("doc_id") % 50 == 0, "open").otherwise(" Reviewed").alias("status"))
    candidates = files.where("path like '%.sol'").select(F.col("path").alias("name"), F.when(F.col("path").like("%/en/%"), "likely high").alias("risk"))
    return gate.completeness(units, candidates, 3, False, coverage_unowned(spark, sf_dir), strict=True)


def worklist_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = location.unit_slug(F.col("path"))
    files = _files(spark, sf_dir)
    work = files.where("path not like '%/fr/%'").select(slug.alias("slug"), F.when(F.col("doc_id") % 2 == 0, "reviewed").otherwise("open").alias("status"))
    return gate.reconcile(work, files.where("path not like '%.md'").select(slug.alias("slug")))


def mark_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = location.unit_slug(F.col("path"))
    files = _files(spark, sf_dir)
    work = files.select(slug.alias("slug"), F.when(F.col("doc_id") % 2 == 0, "open").when(F.col("doc_id") % 3 == 0, "blocked").otherwise("reviewed").alias("status"))
    return gate.mark_reviewed(work, files.where("path like '%.py'").select(slug.alias("slug")))


def unit_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", location.unit_slug(F.col("path")).alias("unit"), location.finding_slug(F.concat(F.lit("--"), "path", F.lit("!!"))).alias("finding"))


def source_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.source_sample(_files(spark, sf_dir), DEFAULT["source_ext"], group=["source"])
    return rows.select("source", "path", F.length("text").alias("n"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select("source", F.sha2(F.concat("path", F.lit("|"), F.sha2("text", 256)), 256).alias("d"))
    return rows.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("digest"))


def poc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _files(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id").alias("name"))
    pocs = _files(spark, sf_dir).where("path not like '%/es/%'").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc_"), "doc_id", F.lit(".t.sol"))).otherwise(F.concat(F.lit("doc_"), "doc_id")).alias("file"))
    return report.poc_for(names, pocs)


QUERIES = {f.__name__: f for f in (classify_paths, noise_strip, entrypoint_candidates, public_api, logic_layers, source_inventory, domain_detect, path_safety, resolve_location, basename_index, verify_text, contained_paths, coverage_unowned, completeness_gate, worklist_reconcile, mark_reviewed, unit_slugs, source_sample, content_digest, poc_match)}

_IN = lambda kind: "(" + ", ".join(f"'{x}'" for x in DEFAULT[kind]) + ")"
_TEST = "contains(path, '/tests/')"
_NOISE = f"({_TEST} OR contains(path, '/vendor/') OR path LIKE '%.md')"
_SUFFIX = r"regexp_extract(path, '[^.](\.[^.]+)$', 1)"
_SOURCE = f"{_SUFFIX} IN {_IN('source_ext')}"
_NAME = "list_last(string_split(path, '/'))"
_INVENTORY = f"inv AS (SELECT path, size FROM files WHERE {_SOURCE} AND NOT {_TEST})"
_REFS = f"refs AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN path WHEN 1 THEN {_NAME} WHEN 2 THEN '../' || path WHEN 3 THEN 'x/' || {_NAME} ELSE 'missing.py' END AS file FROM files)"
_UNOWNED = "art AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '- Files: `' || path || ':12`, x' ELSE 'see-' || path || '.' END AS text FROM files WHERE path NOT LIKE '%/de/%'), un AS (SELECT DISTINCT path FROM inv WHERE NOT EXISTS (SELECT 1 FROM art WHERE contains(art.text, inv.path)))"
_SLUGGED = r"lower(regexp_replace(regexp_replace(regexp_replace(path, '\.py$', ''), '[^A-Za-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'))"

SQL = {
    "classify_paths": f"WITH {cte('files')} SELECT path, {_TEST} AS test, {_NOISE} AS noise, {_SOURCE} AS source, {_SUFFIX} AS suffix, {_NAME} AS name FROM files",
    "noise_strip": f"WITH {cte('files')}, r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 <> 0 THEN path END AS path FROM files) SELECT doc_id, CASE WHEN coalesce({_NOISE}, false) THEN 'skipped' ELSE 'kept' END AS part FROM r",
    "entrypoint_candidates": f"WITH {cte('files')} SELECT path FROM files WHERE NOT {_TEST} AND (regexp_matches(path, '^src1.*/en/.*\\.go$') OR regexp_matches(path, '^.*/de/doc_.\\.ts$') OR ({_SOURCE} AND (contains(text, 'the was') OR contains(text, 'que la'))))",
    "public_api": f"WITH {cte('files')} SELECT path FROM files WHERE NOT {_TEST} AND {_SOURCE} AND regexp_matches(text, '(?m)(?:^[A-Z])|(?:^zzz)')",
    "logic_layers": f"WITH {cte('files')} SELECT path FROM files WHERE NOT {_TEST} AND (path LIKE '%/fr/%.py' OR path LIKE 'src3/%')",
    "source_inventory": f"WITH {cte('files')}, {_INVENTORY} SELECT * FROM inv",
    "domain_detect": f"WITH {cte('files')} SELECT source || '/' || CAST(doc_id % 7 AS VARCHAR) AS dir, CASE WHEN count(*) FILTER (path LIKE '%.sol') > 0 AND 2 * count(*) FILTER (path LIKE '%.sol') >= count(*) THEN 'evm' ELSE 'web' END AS domain FROM files WHERE {_SOURCE} GROUP BY 1",
    "path_safety": "SELECT page_id, page_id % 4 <> 3 AS unsafe FROM pages",
    "resolve_location": f"WITH {cte('files')}, {_REFS}, allf AS (SELECT path FROM files UNION ALL SELECT 'copy/' || {_NAME} FROM files WHERE path LIKE '%1.py'), ix AS (SELECT {_NAME} AS name, min(path) AS path FROM allf GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, file, CASE WHEN file LIKE '../%' THEN NULL ELSE coalesce((SELECT min(path) FROM allf WHERE path = file), (SELECT path FROM ix WHERE name = list_last(string_split(file, '/')))) END AS resolved FROM refs",
    "basename_index": f"WITH {cte('files')}, r AS (SELECT regexp_replace(path, 'doc_[0-9]*([0-9])', 'doc_\\1') AS path FROM files) SELECT {_NAME} AS name, count(*) AS n, min(path) AS path FROM r GROUP BY 1",
    "verify_text": f"WITH {cte('files')}, {_REFS}, ix AS (SELECT {_NAME} AS name, min(path) AS path FROM files GROUP BY 1 HAVING count(*) = 1), v AS (SELECT doc_id, CASE WHEN file LIKE '../%' THEN NULL ELSE coalesce((SELECT path FROM files f WHERE f.path = file), (SELECT path FROM ix WHERE name = list_last(string_split(file, '/')))) END AS resolved FROM refs) SELECT v.doc_id, resolved, CAST(CASE WHEN text IS NULL THEN 0 ELSE least(length(text), 40000) END AS INT) AS n FROM v LEFT JOIN files f ON f.path = resolved",
    "contained_paths": f"WITH {cte('files')}, {_REFS} SELECT doc_id, file FROM refs WHERE file IN (SELECT path FROM files)",
    "coverage_unowned": f"WITH {cte('files')}, {_INVENTORY}, {_UNOWNED} SELECT path FROM un",
    "completeness_gate": f"WITH {cte('files')}, {_INVENTORY}, {_UNOWNED} SELECT * FROM (SELECT 'surface enumerated' AS \"check\", 'failure' AS level, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'units exist', 'failure', 0 UNION ALL SELECT 'units reviewed', 'failure', count(*) FILTER (doc_id % 50 = 0) FROM files UNION ALL SELECT 'candidates graded', 'failure', count(*) FILTER (path LIKE '%.sol' AND path NOT LIKE '%/en/%') FROM files UNION ALL SELECT 'run converged', 'failure', 1 UNION ALL SELECT 'inventory owned', 'failure', count(*) FROM un)",
    "worklist_reconcile": f"WITH {cte('files')} SELECT {_SLUGGED} AS slug, CASE WHEN path NOT LIKE '%/fr/%' AND doc_id % 2 = 0 THEN 'reviewed' ELSE 'open' END AS status, CASE WHEN path LIKE '%.md' THEN 'stale' WHEN path LIKE '%/fr/%' THEN 'added' ELSE 'kept' END AS change FROM files WHERE path NOT LIKE '%/fr/%' OR path NOT LIKE '%.md'",
    "mark_reviewed": f"WITH {cte('files')} SELECT {_SLUGGED} AS slug, CASE WHEN doc_id % 2 = 0 AND path LIKE '%.py' THEN 'reviewed' WHEN doc_id % 2 = 0 THEN 'open' WHEN doc_id % 3 = 0 THEN 'blocked' ELSE 'reviewed' END AS status FROM files",
    "unit_slugs": f"WITH {cte('files')} SELECT path, {_SLUGGED} AS unit, lower(regexp_replace(path, '[^A-Za-z0-9]', '-', 'g')) AS finding FROM files",
    "source_sample": f"WITH {cte('files')}, c AS (SELECT source, path, least(length(text), 16000) AS n FROM files WHERE {_SOURCE}), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT source, path, CAST(n AS INT) AS n FROM s WHERE before < 8000000",
    "content_digest": f"WITH {cte('files')} SELECT source, sha256(array_to_string(list_sort(list(sha256(path || '|' || sha256(text)))), '')) AS digest FROM files GROUP BY source",
    "poc_match": f"WITH {cte('files')} SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS name, CASE WHEN path LIKE '%/es/%' THEN NULL WHEN doc_id % 2 = 0 THEN 'doc_' || CAST(doc_id AS VARCHAR) || '.t.sol' ELSE 'doc_' || CAST(doc_id AS VARCHAR) END AS poc FROM files",
}
