"""Queries on results: matching and scoring of reports, folds over runs, comparison and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import compare, score
from siftstone.queries.adapters import cte, dealt, relation


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each labelled document: it cites its file and a function."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id")
    n = F.col("doc_id")
    text = lambda c: c.cast("string")
    return docs.select(F.concat(F.lit("t"), text(n % 5)).alias("target"), n.alias("seq"), F.concat(F.lit("r"), text(n)).alias("name"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("get /api/"), text(n % 30), F.lit("/*"))).alias("endpoint"), F.when(n % 3 == 0, "sql-injection").otherwise("injection").alias("category"), F.array(F.concat(F.lit("src/f"), text(n % 20), F.lit(".py"))).alias("files"), F.concat(F.lit("calls fn_"), text(n % 12), F.lit(" here")).alias("text"), F.array((n % 50).cast("int")).alias("lines"))


def _key(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """An entry for each labelled document of quality 1, or of any if whole: planted, or safe if it is toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = dealt(labels if whole else labels.where("quality = 1"), "doc_id")
    n = F.col("doc_id")
    text = lambda c: c.cast("string")
    return docs.select(F.concat(F.lit("t"), text(n % 5)).alias("target"), F.when(F.col("toxic") == 1, "safe").otherwise("planted").alias("kind"), n.alias("seq"), F.concat(F.lit("k"), text(n)).alias("id"), F.when(n % 3 == 0, F.concat(F.lit("GET /api/"), text(n % 30), F.lit("/<id>"))).otherwise("").alias("entry"), F.array(F.concat(F.lit("lib/f"), text(n % 20), F.lit(".py"))).alias("files"), F.when(n % 7 == 0, "").otherwise("sql-injection").alias("category"), F.array(F.concat(F.lit("fn_"), text(n % 12))).alias("symbols"))


def score_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.match_pairs(_reports(spark, sf_dir), _key(spark, sf_dir))


def score_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.assign_classes(score.match_classes(_reports(spark, sf_dir), _key(spark, sf_dir)))


def score_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.outcomes(_reports(spark, sf_dir), _key(spark, sf_dir, whole=True))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.summary(score.outcomes(_reports(spark, sf_dir), _key(spark, sf_dir)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "runs").drop("shipped")


def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.fold_runs(_runs(spark, sf_dir))


def run_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.fold_runs(_runs(spark, sf_dir)).withColumn("runs", F.col("found") + F.col("fp") + 2)
    return rows.select("target", "id", score.majority(F.col("found"), F.col("runs")).alias("found"), score.flaky(F.col("found"), F.col("runs")).alias("flaky"))


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.fold_runs(_runs(spark, sf_dir)).withColumn("runs", F.lit(3).cast("long"))
    heads = _runs(spark, sf_dir).groupBy("target", "run").agg(F.count("*").alias("n_reports"), F.count_if(F.col("outcome") == "extra").alias("errors"))
    return score.folded_summary(rows, heads)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = relation(spark, sf_dir, "runs")
    early = F.year("shipped") % 2 == 0
    return rows.where(early).select("id", "outcome").distinct(), rows.where(~early).select("id", "outcome").distinct()


def compare_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.flips(*_halves(spark, sf_dir))


def catch_rate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "runs")
    early = F.year("shipped") % 2 == 0
    rate = lambda part: part.groupBy("id").agg(F.count_if(F.col("outcome") == "found").alias("found"), F.count("*").alias("runs"))
    return compare.catch_rate_moves(rate(rows.where(early)), rate(rows.where(~early)), compare.flips(*_halves(spark, sf_dir)))


def compare_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 10")
    refs = F.array(F.concat(F.lit("guide:languages/"), F.lower("p_brand")), F.concat(F.lit("guide:frameworks/py/"), F.col("p_size").cast("string")), F.concat(F.lit("vuln:"), F.lower("p_type")))
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), refs.alias("refs"), F.array(F.lower("p_type"), F.lit("x")).alias("tags"))
    flips = compare.flips(*_halves(spark, sf_dir))
    out = [compare.flips_by_axis(flips, rows, axis).groupBy("flip", "label").agg(F.count("*").alias("n")).withColumn("axis", F.lit(axis)) for axis in ("language", "framework", "vulnerability", "tag")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _halves(spark, sf_dir)
    return compare.regression_gate(before, after, F.lit(2), F.lit(0.5), 0.8)


def diff_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.col("o_orderkey").cast("string").alias("name")
    cases = orders.select(name, F.when(F.col("o_orderkey") % 2 == 0, "sql-injection").otherwise("").alias("category"))
    audits = orders.where("o_orderstatus <> 'P'").select(name, (F.col("o_orderkey") % 3).alias("n_kept"), (F.col("o_orderkey") % 13 == 0).alias("failed"), F.when(F.col("o_orderkey") % 17 == 0, True).alias("degraded"))
    return score.diff_outcomes(cases, audits)


QUERIES = {f.__name__: f for f in (score_match, score_greedy, score_outcomes, score_summary, run_fold, run_majority, recall_precision, compare_flips, catch_rate_moves, compare_by_axis, regression_gate, diff_probe)}

_PAIRS = """rp AS (SELECT 't' || CAST(doc_id % 5 AS VARCHAR) AS target, doc_id AS seq, 'r' || CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 30 AS VARCHAR) END AS ep, CASE WHEN doc_id % 3 = 0 THEN 'sql-injection' ELSE 'injection' END AS category, doc_id % 20 AS f, doc_id % 12 AS sym FROM labels),
ky AS (SELECT 't' || CAST(doc_id % 5 AS VARCHAR) AS target, CASE WHEN toxic = 1 THEN 'safe' ELSE 'planted' END AS kind, doc_id AS seq, 'k' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 30 AS VARCHAR) ELSE '' END AS ep, doc_id % 20 AS f, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'sql-injection' END AS category, doc_id % 12 AS sym FROM labels WHERE quality = 1),
pr AS (SELECT r.target, k.kind, k.seq AS entry_seq, k.id, r.seq AS report_seq, r.name FROM rp r JOIN ky k USING (target) WHERE CASE WHEN k.ep <> '' THEN CASE WHEN k.kind = 'planted' THEN r.ep = k.ep OR (r.f = k.f AND r.sym = k.sym) ELSE r.ep = k.ep END ELSE r.f = k.f AND r.sym = k.sym END)"""
_ASSIGN = f"""{_PAIRS}, lists AS (SELECT target, entry_seq, id, list(name ORDER BY report_seq) AS ns FROM pr WHERE kind = 'planted' GROUP BY ALL), ord AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY entry_seq, id) AS rn FROM lists),
fold AS (SELECT target, rn, id, ns[1] AS name, [ns[1]] AS used FROM ord WHERE rn = 1 UNION ALL SELECT o.target, o.rn, o.id, list_filter(o.ns, lambda x: NOT list_contains(f.used, x))[1], CASE WHEN len(list_filter(o.ns, lambda x: NOT list_contains(f.used, x))) = 0 THEN f.used ELSE list_append(f.used, list_filter(o.ns, lambda x: NOT list_contains(f.used, x))[1]) END FROM fold f JOIN ord o ON o.target = f.target AND o.rn = f.rn + 1),
asg AS (SELECT target, id, name FROM fold WHERE name IS NOT NULL)"""
_OUT = f"""{_ASSIGN}, wr AS (SELECT DISTINCT target, name FROM pr WHERE kind = 'safe' AND (target, name) NOT IN (SELECT target, name FROM pr WHERE kind = 'planted')),
res AS (SELECT target, id, 'found' AS outcome FROM asg UNION ALL SELECT target, id, 'missed' FROM ky WHERE kind = 'planted' AND (target, id) NOT IN (SELECT target, id FROM asg) UNION ALL SELECT target, name, 'false_positive' FROM wr UNION ALL SELECT target, name, 'extra' FROM rp WHERE (target, name) NOT IN (SELECT target, name FROM asg) AND (target, name) NOT IN (SELECT target, name FROM wr))"""
_FOLD = f"{cte('runs')}, nr AS (SELECT target, count(DISTINCT run) AS runs FROM runs GROUP BY target), fd AS (SELECT target, id, count(*) FILTER (outcome = 'found') AS found, count(*) FILTER (outcome = 'false_positive') AS fp, bool_or(outcome IN ('found', 'missed')) AS planted FROM runs WHERE outcome <> 'extra' GROUP BY target, id)"
_FLIPS = f"{cte('runs')}, b AS (SELECT DISTINCT id, outcome FROM runs WHERE year(shipped) % 2 = 0 AND outcome IN ('found', 'false_positive')), a AS (SELECT DISTINCT id, outcome FROM runs WHERE year(shipped) % 2 <> 0 AND outcome IN ('found', 'false_positive')), fl AS (SELECT id, CASE outcome WHEN 'found' THEN 'newly_found' ELSE 'newly_false_positive' END AS flip FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, CASE outcome WHEN 'found' THEN 'newly_missed' ELSE 'fixed_false_positive' END FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"
_RATES = "CASE WHEN {0} + {1} > 0 THEN round_even({0} / ({0} + {1}), 4) ELSE 1.0 END"

SQL = {
    "score_match": f"WITH {_PAIRS} SELECT * FROM pr",
    "score_greedy": f"WITH RECURSIVE {_ASSIGN} SELECT * FROM asg",
    "score_outcomes": f"WITH RECURSIVE {_OUT.replace(' WHERE quality = 1', '')} SELECT * FROM res",
    "score_summary": f"WITH RECURSIVE {_OUT}, c AS (SELECT target, count(*) FILTER (outcome = 'found') AS found, count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'false_positive') AS false_positive, count(*) FILTER (outcome = 'extra') AS extra FROM res GROUP BY target) SELECT *, {_RATES.format('found', 'missed')} AS recall, {_RATES.format('found', 'false_positive')} AS precision_known, missed = 0 AND false_positive = 0 AS clean FROM c",
    "run_fold": f"WITH {_FOLD} SELECT target, id, found, fp, planted, runs FROM fd JOIN nr USING (target)",
    "run_majority": f"WITH {_FOLD} SELECT target, id, 2 * found > found + fp + 2 AS found, found > 0 AND found < found + fp + 2 AS flaky FROM fd",
    "recall_precision": f"WITH {_FOLD}, c AS (SELECT target, count(*) FILTER (planted AND 2 * found > 3) AS n_found, count(*) FILTER (planted AND NOT 2 * found > 3) AS n_missed, count(*) FILTER (2 * fp > 3) AS n_fp, count(*) FILTER (planted AND found > 0 AND found < 3) AS n_flaky FROM fd GROUP BY target), h AS (SELECT target, count(*) AS reports, count(*) FILTER (outcome = 'extra') AS errors FROM runs GROUP BY target) SELECT *, {_RATES.format('n_found', 'n_missed')} AS recall, {_RATES.format('n_found', 'n_fp')} AS precision_known FROM c JOIN h USING (target)",
    "compare_flips": f"WITH {_FLIPS} SELECT * FROM fl",
    "catch_rate_moves": f"WITH {_FLIPS}, rb AS (SELECT id, count(*) FILTER (outcome = 'found') / count(*) AS r FROM runs WHERE year(shipped) % 2 = 0 GROUP BY id), ra AS (SELECT id, count(*) FILTER (outcome = 'found') / count(*) AS r FROM runs WHERE year(shipped) % 2 <> 0 GROUP BY id), j AS (SELECT coalesce(ra.id, rb.id) AS id, round_even(coalesce(rb.r, 0), 3) AS rate_before, round_even(coalesce(ra.r, 0), 3) AS rate_after FROM ra FULL JOIN rb ON ra.id = rb.id) SELECT * FROM j WHERE rate_before <> rate_after AND id NOT IN (SELECT id FROM fl WHERE flip IN ('newly_found', 'newly_missed'))",
    "compare_by_axis": f"WITH {_FLIPS}, attr AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(p_brand) AS l, CAST(p_size AS VARCHAR) AS f, lower(p_type) AS v FROM part WHERE p_size > 10), x AS (SELECT flip, 'language' AS axis, coalesce(l, 'unattributed') AS label FROM fl LEFT JOIN attr USING (id) UNION ALL SELECT flip, 'framework', coalesce(f, 'unattributed') FROM fl LEFT JOIN attr USING (id) UNION ALL SELECT flip, 'vulnerability', coalesce(v, 'unattributed') FROM fl LEFT JOIN attr USING (id) UNION ALL SELECT flip, 'tag', coalesce(v, 'unattributed') FROM fl LEFT JOIN attr USING (id) UNION ALL SELECT flip, 'tag', 'x' FROM fl JOIN attr USING (id)) SELECT flip, label, count(*) AS n, axis FROM x GROUP BY ALL",
    "regression_gate": f"WITH {_FLIPS} SELECT 'errors' AS rule, '2' AS detail UNION ALL SELECT 'precision below floor', '0.5' UNION ALL SELECT CASE flip WHEN 'newly_missed' THEN 'newly missed' ELSE 'new false positive' END, id FROM fl WHERE flip IN ('newly_missed', 'newly_false_positive')",
    "diff_probe": "SELECT CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'error' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'found' WHEN o_orderkey % 2 = 0 THEN 'missed' WHEN o_orderkey % 3 > 0 THEN 'false_positive' ELSE 'clean' END AS outcome FROM orders",
}
