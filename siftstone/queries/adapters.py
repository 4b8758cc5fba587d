"""Projections of the test tables to the engine's relations. Each is a list of SQL expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
LEVEL = "CASE {} % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"
#: Relations: the table and its columns by name.
RELATIONS: dict[str, tuple[str, dict[str, str]]] = {
    "candidates": ("events", {
        "seq": "event_id", "pass_no": "CAST(day(ts) AS INT)", "unit": "'unit_' || CAST(user_id % 10 AS VARCHAR(20))", "title": "event_type || ' in fn_' || CAST(user_id % 97 AS VARCHAR(20))",
        "category": "CASE event_id % 3 WHEN 0 THEN 'SQL_Injection' WHEN 1 THEN 'missing auth' ELSE event_type END",
        "endpoint": "CASE WHEN event_id % 5 = 0 THEN '' ELSE 'GET  /' || event_type || '/<id>/' || CAST(user_id % 7 AS VARCHAR(20)) END",
        "symbol": "CASE WHEN event_id % 4 = 0 THEN 'Service.fn_' || CAST(user_id % 97 AS VARCHAR(20)) ELSE '' END", "file": "'src/' || event_type || '.py'", "line": f"NULLIF({K}, 0)",
        "severity": LEVEL.format("event_id"), "evidence": f"'k' || CAST({K} AS VARCHAR(20))", "status": "CASE WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'open' END", "source": "'review'", "model": "'m' || CAST(user_id % 3 AS VARCHAR(20))",
    }),
    "findings": ("events", {
        "seq": "event_id", "reviewer": "'u' || CAST(user_id AS VARCHAR(20))", "file": "CASE WHEN event_id % 13 = 0 THEN 'tests/' || event_type || '.py' WHEN event_id % 17 = 0 THEN 'vendored/' || event_type || '.py' ELSE 'src/' || event_type || '.py' END", "line": f"NULLIF({K}, 0)",
        "severity": LEVEL.format("event_id"), "category": "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END", "description": "'user ' || CAST(user_id % 20 AS VARCHAR(20))", "exploit_scenario": "'k'", "recommendation": "''", "confidence": "value / 500",
    }),
    "files": ("documents", {
        "path": "source || '/' || lang || '/' || CASE WHEN doc_id % 11 = 0 THEN 'tests/' WHEN doc_id % 13 = 0 THEN 'vendor/' ELSE '' END || 'doc_' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.lock' ELSE '.sol' END",
        "doc_id": "doc_id", "source": "source", "text": "text", "size": "n_chars",
    }),
    "endpoints": ("pages", {
        "page_id": "page_id", "entry": "CASE page_id % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'POST ' ELSE '' END || regexp_replace(url, '^https?://[^/]*', '')",
        "report": "CASE page_id % 2 WHEN 0 THEN '`get` /api' ELSE 'POST ' END || regexp_replace(url, '^https?://[^/]*', '') || CASE page_id % 5 WHEN 0 THEN ', PUT /en/<id>' WHEN 1 THEN ' (handler)' ELSE '' END",
    }),
    "runs": ("lineitem", {
        "target": "'t' || CAST(l_suppkey % 3 AS VARCHAR(20))", "id": "CAST(l_partkey AS VARCHAR(20))", "run": "l_linenumber", "outcome": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'false_positive' WHEN l_returnflag = 'R' THEN 'found' WHEN l_returnflag = 'A' THEN 'missed' ELSE 'extra' END", "shipped": "l_shipdate",
    }),
    "votes": ("lineitem", {"key": "CAST(l_orderkey AS VARCHAR(20))", "vote_no": "l_linenumber", "completed": "l_linenumber % 4 <> 0", "real": "l_returnflag = 'R'", "reason": "'r' || CAST(l_linenumber AS VARCHAR(20))"}),
    "functions": ("lineitem", {"contract": "'c' || CAST(l_suppkey % 50 AS VARCHAR(20))", "fn": "'p' || CAST(l_partkey AS VARCHAR(20)) || '(uint)'", "quantity": "l_quantity", "line": "l_linenumber", "flag": "l_returnflag"}),
    "calls": ("conversations", {"conv_id": "conv_id", "seq": "turn", "unit": "'conv_' || CAST(conv_id % 40 AS VARCHAR(20))", "n": "CAST(length(text) AS BIGINT)", "role": "role"}),
    "items": ("part", {"id": "p_partkey", "ref": "'vuln:' || lower(replace(p_brand, '#', '-'))", "kind": "CASE WHEN p_size % 2 = 0 THEN 'vulnerability' ELSE 'guide' END", "tag": "lower(p_type)", "size": "p_size"}),
}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a hash of the key: a small file, or one of a single row group, is read by one task, whatever comes after."""
    return rows.repartition(max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RELATIONS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(*(F.expr(e).alias(n) for n, e in columns.items()))


def cte(*names: str) -> str:
    """A WITH clause's members that define the relations in SQL."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in RELATIONS[n][1].items())} FROM {RELATIONS[n][0]})" for n in names)
