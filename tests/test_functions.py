import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from siftstone.functions import category, coerce, endpoint, jsonscan, lines, location, severity, text


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("below", "LOW"), ("High/critical", "CRITICAL"), (None, "MEDIUM"), ("\t high ", "HIGH"), ("urgent", "MEDIUM")])
def test_severity_is_the_worst_level_in_the_text(spark, given, want):
    assert value(spark, severity.normalize(F.lit(given).cast("string"))) == want


def test_exact_severity_takes_no_other_text(spark):
    assert value(spark, severity.exact(F.lit(" high"))) == "MEDIUM"
    assert value(spark, severity.exact(F.lit("high"))) == "HIGH"


@pytest.mark.parametrize(("levels", "want"), [(["LOW", "HIGH", "MEDIUM"], "MEDIUM"), (["LOW", "HIGH"], "HIGH"), (["LOW"], "LOW"), ([], "MEDIUM"), (["CRITICAL", "LOW", "LOW", "LOW"], "LOW")])
def test_median_takes_the_upper_middle(spark, levels, want):
    df = spark.createDataFrame([(x,) for x in levels], "x string")
    row = df.agg(severity.median_level(F.col("x")).alias("a"), severity.upper_median(F.collect_list(severity.rank(F.col("x")))).alias("b")).first()
    assert (row["a"], row["b"]) == (want, want)


@pytest.mark.parametrize(("a", "b", "want"), [
    ("POST /api/v1/memories/123/update", "POST /memories/<id>/update", True), ("GET /api/v1/memories/123/update", "POST /memories/<id>/update", False),
    ("GET /wallets/<id>", "GET /wallets", False), ("GET /api/search/?query=x", "GET /api/search/", True), ("GET /a/content POST /a/write", "POST /a/write", True),
    ("`GET` `/x/{id}` (tRPC x.get)", "get /x/<x_id>", True), ("GET /a/<id>, GET /b/<id>", "GET /b/7", True), ("", "GET /b", False), ("message queue consumer", "message queue consumer", True),
])
def test_endpoints(spark, a, b, want):
    assert value(spark, endpoint.endpoint_match(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(("a", "b", "want"), [("injection", "code-injection", True), ("sql-injection", "code-injection", False), ("", "code-injection", False), ("x", "x", True)])
def test_categories_match_by_words(spark, a, b, want):
    assert value(spark, category.category_match(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(("given", "want"), [("signature-replay", "replay-attack"), ("access control", "missing-authorization"), ("access-control", "access-control"), (" Odd  Thing_ ", "odd-thing"), (None, "")])
def test_category_of(spark, given, want):
    assert value(spark, category.category_of(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [("true", 0.5), ("0.7", 0.7), ("1.5", 0.5), ("nan", 0.5), ("0.7f", 0.5), (None, 0.5), ("1e-1", 0.1), ("-0.1", 0.5)])
def test_confidence(spark, given, want):
    assert value(spark, coerce.to_float(F.lit(given).cast("string"))) == want


def test_findings_are_coerced_field_by_field(spark):
    reply = '{"findings": [{"file": "a.py", "line": true, "severity": "low", "confidence": "0.7"}, {"file": " ", "line": 1}, {"file": "b.py", "line": 7, "confidence": 2}, {"file": "c.py", "line": 0}]}'
    rows = spark.range(1).select(F.inline(coerce.findings(F.lit(reply)))).collect()
    assert [(r["file"], r["line"], r["severity"], r["confidence"]) for r in rows] == [("a.py", None, "LOW", 0.7), ("b.py", 7, "MEDIUM", 0.5), ("c.py", None, "MEDIUM", 0.5)]
    assert value(spark, coerce.findings(F.lit('{"other": 1}'))) is None


@pytest.mark.parametrize(("path", "want"), [("", True), ("/etc/passwd", True), ("a/../b", True), ("a/b.py", False), ("a..b/c", False), ("..\\x", True)])
def test_unsafe_paths(spark, path, want):
    assert value(spark, location.is_unsafe(F.lit(path))) is want


@pytest.mark.parametrize("pattern", ["*.py", "src/*/x?.go", "[ab]*", "[!a]b", "a.b", "test_*", "a+b", "[", "x[", "**", "a[]]b", "a^b$"])
def test_globs(spark, pattern):
    names = ["a.py", "src/q/r/x1.go", "b", "ab", "cb", "a.b", "axb", "test_", "a+b", "[", "x[", "a]b", "a^b$", "x\n.py"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.matches_glob(F.col("n"), [pattern]).alias("x"))
    assert {r["n"]: r["x"] for r in df.collect()} == {n: fnmatch.fnmatchcase(n, pattern) for n in names}


def test_whole_token(spark):
    assert value(spark, text.whole_token(F.lit("approved allowance"), F.lit("approve"))) is False
    assert value(spark, text.whole_token(F.lit("approve skips"), F.lit("approve"))) is True
    assert value(spark, text.whole_token(F.lit("a $queryRaw b"), F.lit("$queryRaw"))) is True
    assert value(spark, text.whole_token(F.lit("préapprove"), F.lit("approve"))) is False


def test_strip_takes_all_white_space(spark):
    assert value(spark, text.strip(F.lit(" \t a b \n"))) == "a b"


@pytest.mark.parametrize(("reply", "want"), [
    ('{"a": 1}', {"a": 1}), ("[1, 2, 3]", None), ("", None), ("{not valid}", None), ('x {"a": "{"} y', {"a": "{"}), ('```json\n{"a": 2}\n```', {"a": 2}),
    ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "b\\"c"} {"d": 1}', {"a": 'b"c'}), ('{bad} {"ok": 1}', {"ok": 1}), ('{"a": 1,}', {"a": 1}),
])
def test_json_objects(reply, want):
    assert jsonscan.extract_object(reply) == want


def test_symbol_spans(spark):
    python = "import x\n\ndef one(a):\n    return a\n\n\ndef two():\n    pass\n"
    braces = "contract C {\n  function go() public {\n    if (x) { y; }\n  }\n  function stop() {}\n}\n"
    assert jsonscan.symbol_span(python, "one") == (3, 6)
    assert jsonscan.symbol_span(braces, "Go") == (2, 4)
    assert jsonscan.symbol_span(braces, "none") is None
    row = spark.createDataFrame([(python, "two"), (python, "zzz")], "t string, s string").select(jsonscan.symbol_lines("t", "s").alias("x")).collect()
    assert (row[0]["x"]["first"], row[0]["x"]["last"], row[1]["x"]["first"]) == (7, 8, None)


def test_windows_against_a_loop(spark):
    body = "\n".join(("x" if i % 7 == 0 else "  y") + "z" * (i % 23) for i in range(400)) + "\n" + " " * 700 + "\nend"
    size, window, overlap = len(body), 300, 50
    starts = [m.start() for m in re.finditer(r"(?m)^\S", body)]
    want, at = [], 0
    while True:
        if at + window >= size:
            want.append((at, size))
            break
        inside = [b for b in starts if at < b <= at + window]
        want.append((at, inside[-1] if inside else at + window))
        at = inside[-1] if inside else at + window - overlap
    df = spark.createDataFrame([(body,)], "t string")
    found = df.select(lines.boundaries(F.col("t")).alias("b"), lines.windows(F.length("t"), lines.boundaries(F.col("t")), window, overlap).alias("w")).first()
    assert found["b"] == starts
    assert [(x["start"], x["end"]) for x in found["w"]] == want


def test_numbered_lines(spark):
    assert value(spark, lines.numbered(F.lit("\n".join("abcdefghij")))).split("\n")[0] == " 1 | a"


def test_chunk_paths(spark):
    assert value(spark, location.chunk_path(F.lit("diff --git a/x b/y\n--- a/x\n+++ b/y\n"))) == "y"
    assert value(spark, location.chunk_path(F.lit("diff --git a/x b/y\n--- a/x\n+++ /dev/null\n"))) == "x"
    assert value(spark, location.chunk_path(F.lit("diff --git a/x b/y\n"))) == "y"
    assert value(spark, location.chunk_path(F.lit("nothing"))) == ""
