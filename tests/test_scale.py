"""What is worked out once, dealt out, or read in pieces."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import jsonscan, replies, text
from siftstone.operators import select
from siftstone.queries import adapters
from siftstone.sources import notes

NOTE = "---\nkind: language\ntitle: x: y\nkind: protocol\ndetect_files: [*.a, \"*.b\"]\ndetect_manifest: Gem\n---\nbody\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_are_read_once_for_all_signals(spark):
    docs = spark.createDataFrame([("n", NOTE), ("plain", "no block")], "name string, text string")
    got = notes.guide_signals(docs)
    assert plan(got).count("Scan") == 1
    assert {tuple(r) for r in got.collect()} == {("n", "file", "*.a"), ("n", "file", "*.b"), ("n", "manifest", "gem")}


def test_the_first_of_a_front_matter_key_counts(spark):
    docs = spark.createDataFrame([("n", NOTE)], "name string, text string")
    row = notes.frontmatter(docs).first()
    assert (row["meta"]["kind"], row["meta"]["title"], row["body"]) == ("language", "x: y", "body\n")
    # lines are parsed in one place, not once for each key and once more for each value
    assert plan(notes.frontmatter(docs)).count("^[^:]*:") == 1


def test_guides_are_numbered_without_one_task(spark):
    docs = spark.createDataFrame([(f"g{i:03}", f"---\nkind: {('protocol', 'language', 'other')[i % 3]}\n---\nb{i}") for i in range(90)], "name string, text string")
    got = notes.guides(docs)
    assert "Exchange SinglePartition" not in plan(got.select("id", "body"))
    order = sorted(range(90), key=lambda i: ({1: 0, 0: 2, 2: 3}[i % 3], i))
    assert [(r["seq"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["seq"])] == [(n, f"g{i:03}") for n, i in enumerate(order)]
    assert dict(got.dtypes)["seq"] == "int"


def test_settings_lines_are_parsed_in_one_place(spark):
    df = spark.createDataFrame([("A=1\nB='x'\nA=2",)], "text string").select(replies.env_pairs(F.col("text")).alias("p"))
    assert plan(df).count("^[^=]*=") == 1
    assert [tuple(x) for x in df.first()["p"]] == [("B", "x"), ("A", "2")]


def test_rows_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = adapters.dealt(spark.read.parquet(str(tmp_path / "t")), "id")
    assert rows.rdd.getNumPartitions() >= 32 and rows.distinct().count() == 1000


@pytest.mark.parametrize("name", ["f1", "a.b", "$x", "x$", "é"])
def test_declarations_are_those_of_the_pattern(name):
    words = ["def", "func", "function", "undef", "x", name, f"{name}2", f"a{name}", "=", "(", ":", " ", " ", ".", "é", "_"]
    pattern = re.compile(rf"(?:{'|'.join(jsonscan.DECLARES)})\b.*\b{re.escape(name)}\b|\b{re.escape(name)}\b\s*[=(:]")
    rng = random.Random(name)
    lines = ["".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(3000)]
    assert [jsonscan.declares(x, name) for x in lines] == [bool(pattern.search(x)) for x in lines]


def test_texts_are_searched_in_pieces(spark, monkeypatch):
    assert list(select.pieces(np.array([0, 3, 6, 20, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 5)]
    assert list(select.pieces(np.array([0]), 6)) == [] and list(select.pieces(np.array([5, 5, 5]), 6)) == [(0, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    texts = spark.createDataFrame([(i, "x" * 3_000 + ("needle" if i % 3 == 0 else "")) for i in range(3_000)], "id int, text string").coalesce(1)
    needles = spark.createDataFrame([("needle",), ("edle",)], "needle string")
    assert {(r["id"], r["needle"]) for r in select.contained(texts, needles).collect()} == {(i, n) for i in range(0, 3_000, 3) for n in ("needle", "edle")}


def test_a_value_is_worked_out_once(spark):
    df = spark.range(3).select(text.once(F.col("id") + 1, lambda x: x * x).alias("x"))
    assert sorted(r["x"] for r in df.collect()) == [1, 4, 9]


def test_note_fields_are_read_once(spark):
    docs = spark.createDataFrame([("a", "# T\n\n- Status: open\n- Location: `src/a.py:3`\n- Class: x\n\n## Evidence\n\ne"), ("b", "no place"), ("c", "- Status: refuted\n- File: b.py")], "name string, text string")
    got = notes.candidate_notes(docs)
    assert plan(got).count("location|file|source location") == 1
    assert [tuple(r) for r in got.select("name", "title", "category", "endpoint", "file", "line", "severity", "status").collect()] == [("a", "T", "x", "", "src/a.py", 3, "", "open")]


def test_call_graph_reads_each_side_once(spark):
    """Calls are read once for both of their ends, and a text of facts once for all that finds it."""
    from siftstone.operators import callgraph

    functions = spark.createDataFrame([("c", "a", "f", 0, 5, True), ("c", "b", "f", 5, 9, False), ("c", "d", "f", 9, 12, False)], "contract string, fn string, file string, start int, end int, risky boolean")
    calls = spark.createDataFrame([("c", "a", "a", 4), ("c", "a", "b", None), ("c", "a", "b", 0), ("c", "b", "a", 1), ("c", "d", "a", 2), ("c", "a", None, 3)], "contract string, caller string, callee string, seq int")
    marked = calls.join(spark.range(7_001, 7_002).select(F.lit("c").alias("contract")), "contract")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = callgraph.neighbours(functions, marked, F.col("risky"))
    assert sorted(tuple(r) for r in got.select("anchor", "fn", "hop", "seq", "size").collect()) == [("a", "a", 0, 0, 5), ("a", "b", 1, None, 4), ("a", "d", 2, 2, 3)]
    assert plan(got).count("Range (7001") == 1
    facts = spark.createDataFrame([("x/f", "1"), ("x/f", "0"), ("a/f", "2"), ("a/g", "3")], "file string, block string")
    units = spark.createDataFrame([("u", "x/f"), ("v", "q/f"), ("w", "q/g"), ("z", "none"), ("n", None)], "unit string, path string")
    told = callgraph.facts_for_units(units, facts)
    assert sorted(tuple(r) for r in told.collect()) == [("u", "x/f", "0\n\n1"), ("v", "q/f", "2"), ("w", "q/g", "3")]
    assert plan(told).count("collect_list(block") == 1
