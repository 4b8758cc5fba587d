import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import select, usage
from siftstone.plans import evaluate, review_diff, review_repository, seams
from siftstone.sources import checkpoint, files, keys, notes, payload, rules
from siftstone.streaming import running
from tests.tables import candidates, column

DIFF = "diff --git a/app.py b/app.py\n--- a/app.py\n+++ b/app.py\n+replay(x)\ndiff --git a/tests/t.py b/tests/t.py\n--- a/tests/t.py\n+++ b/tests/t.py\n+1\n"


def test_diff_review_end_to_end(spark):
    diffs = spark.createDataFrame([(0, DIFF), (1, DIFF.replace("app.py", "bad.py")), (2, "diff --git a/x.md b/x.md\n+++ b/x.md\n+doc\n")], "diff_id long, diff string")
    provider = seams.Canned({"bad.py": None, "app.py": seams.reply_of([{"file": "app.py", "line": 4, "category": "Replay Attack", "confidence": 0.9}, {"file": "app.py", "line": 4, "category": "zzz", "confidence": 0.2}])})
    known = spark.createDataFrame([("replay-attack", "high")], "id string, impact string")
    triggers = spark.createDataFrame([("replay-attack", "replay(")], "vuln_id string, trigger string")
    kept, dropped, failed = review_diff.review(diffs, provider, known, triggers, known, rules.DEFAULT)
    assert [(r["diff_id"], r["category"]) for r in kept.collect()] == [(0, "replay-attack")]
    assert [(r["reason"], r["category"]) for r in dropped.collect()] == [("low confidence", "other")]
    assert column(failed, "diff_id") == [1]


def test_repository_seed(spark):
    tree = files.from_list(spark, [("app/routes.py", "@route('/a')\ndef a(): pass\n"), ("app/services/s.py", "def s(): pass\n"), ("requirements.txt", "Flask\n")])
    units = review_repository.seeded_units(tree, rules.DEFAULT, [], ["@route"], [], ["*/services/*"])
    assert [r["files"] for r in units.collect()] == [["app/routes.py", "app/services/s.py"]]
    with pytest.raises(ValueError, match="no unit"):
        review_repository.seeded_units(tree, rules.DEFAULT, [], ["@none"], [], [])
    guides = spark.createDataFrame([(0, "flask"), (1, "go")], "seq int, id string")
    signals = spark.createDataFrame([("flask", "manifest", "flask"), ("go", "file", "*.go")], "guide_id string, signal string, pattern string")
    assert column(select.select_guides(tree, files.manifest_text(tree, ["requirements.txt"]), tree, guides, signals), "id") == ["flask"]


def test_tree_is_read(spark, tmp_path):
    for name, body in {"a.py": b"x = 1\n", "node_modules/b.py": b"y", "c/bin.py": b"\xff\xfe", "c/d.md": b"# D"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: r["text"] for r in files.read_tree(spark, str(tmp_path), rules.DEFAULT).collect()}
    assert got == {"a.py": "x = 1\n", "c/bin.py": "", "c/d.md": "# D"}


def test_run_and_finalize_differ_in_order(spark):
    rows = candidates(spark, [{"category": "a", "line": 1}, {"category": "b", "line": 1, "pass_no": 2}])
    aliases = spark.createDataFrame([("a", "x"), ("b", "x")], "alias string, id string")
    passes = spark.createDataFrame([(1, True), (2, True)], "pass_no int, clean boolean")
    assert review_repository.run(rows, passes, aliases).count() == 2
    assert review_repository.finalize(rows, aliases).count() == 1


def test_resume(spark):
    units = spark.createDataFrame([("a",), ("b",)], "unit string")
    done = units.where("unit = 'a'")
    assert column(review_repository.resumed(units, done, units), "unit") == ["b"]
    with pytest.raises(ValueError, match="union"):
        review_repository.resumed(units, done, None)


def test_votes_from_replies(spark):
    rows = spark.createDataFrame([("k1", "real one", ["a.py"]), ("k2", "refute", ["a.py"]), ("k3", "fail", []), ("k4", "garbage", [])], "key string, prompt string, shown array<string>")
    provider = seams.Canned({"real one": '{"real": true}', "refute": '{"real": false, "reason": "safe", "controls": ["a.py:3"]}', "fail": None, "garbage": "?"})
    got = {r["key"]: (r["completed"], r["real"]) for r in seams.voted(rows, provider).collect()}
    assert got == {"k1": (True, True), "k2": (True, False), "k3": (False, False), "k4": (False, False)}


def test_failed_units_stay_open(spark):
    units = spark.createDataFrame([("u1", 1, "one"), ("u2", 1, "two")], "unit string, pass_no int, prompt string")
    found, reviews = seams.reviewed(units, seams.Canned({"one": seams.reply_of([{"title": "T", "file": "/abs"}]), "two": "no json"}))
    assert [(r["title"], r["file"]) for r in found.collect()] == [("T", "")]
    assert {r["unit"]: r["ok"] for r in reviews.collect()} == {"u1": True, "u2": False}


def test_answer_keys_are_strict(spark):
    entry = {"id": "a", "entry": "GET /a", "symbol": " Fn "}
    rows = keys.answer_key(spark, {"target": "t", "issues": [entry], "safe": [{"id": "s", "file": "x.py"}]}).collect()
    assert [(r["kind"], r["files"], r["symbols"]) for r in rows] == [("planted", [], ["fn"]), ("safe", ["x.py"], [])]
    for bad in ({"target": "t"}, {"planted": [{"id": "a"}]}, {"planted": [{"entry": "x"}]}):
        with pytest.raises(ValueError):
            keys.answer_key(spark, bad)
    with pytest.raises(ValueError, match="two cases"):
        keys.diff_cases(spark, [{"name": "a", "diff": "d"}, {"name": "a", "diff": "d"}])


def test_benchmark_roots(spark):
    one, two = (spark.createDataFrame([("a", k), (k, k)], "id string, kind string") for k in "xy")
    assert sorted(tuple(r) for r in keys.merged_benchmarks([(0, one, False), (1, two, True)]).collect()) == [("a", "y"), ("x", "x"), ("y", "y")]
    with pytest.raises(ValueError):
        keys.merged_benchmarks([(0, one, False), (1, two, False)])


def test_payloads(spark):
    plain = ("0x1", "A", "contract A {}")
    standard = ("0x2", "B", "{" + json.dumps({"sources": {"src\\b.sol": {"content": "B"}}}) + "}")
    mapped = ("0x3", "C", json.dumps({"c.sol": "C"}))
    rows = spark.createDataFrame([plain, standard, mapped], "address string, contract_name string, source_code string")
    assert sorted((r["path"], r["text"]) for r in payload.reconstructed(rows).collect()) == [("A.sol", "contract A {}"), ("c.sol", "C"), ("src/b.sol", "B")]
    with pytest.raises(ValueError):
        payload.source_files(json.dumps({"../x.sol": "C"}), "X")


def test_notes(spark):
    text = "# Title\n- Location: `src/a.py:12`\n- Class: IDOR\n- Source: GET /a/<id>\n- Risk: High\n\n## Evidence\nin src/a.py:14 and other.py:3\n"
    rows = spark.createDataFrame([("n", text), ("gone", text.replace("# Title", "# Cleared: x")), ("abs", text.replace("src/a.py:12", "/a.py"))], "name string, text string")
    got = notes.candidate_notes(rows).collect()
    assert [(r["name"], r["file"], r["line"], r["category"]) for r in got] == [("n", "src/a.py", 12, "IDOR")]
    report = notes.finding_notes(rows.where("name = 'n'"), [".py"]).first()
    assert (report["category"], report["endpoint"], report["files"], report["lines"]) == ("insecure-direct-object-reference", "get /a/*", ["other.py", "src/a.py"], [3, 12, 14])
    docs = spark.createDataFrame([("a", "---\ntitle: T\ntriggers: [x, \"Y\"]\ndetect_manifest: Flask\n---\nBody\n"), ("index", "x")], "name string, text string")
    row = notes.knowledge_docs(docs).collect()
    assert [(r["id"], r["title"], r["triggers"], r["body"]) for r in row] == [("a", "T", ["x", "Y"], "Body")]
    assert [tuple(r) for r in notes.guide_signals(docs).collect()] == [("a", "manifest", "flask")]


def test_evaluation(spark):
    from tests.test_operators import KEY, REPORT

    key = spark.createDataFrame([("t", "planted", 0, "a", "GET /a", [], "x", []), ("t", "planted", 1, "b", "GET /b", [], "x", [])], KEY)
    run = lambda *eps: spark.createDataFrame([("t", i, f"r{i}", e, "x", [], "", []) for i, e in enumerate(eps)], REPORT)
    done = evaluate.evaluate([run("get /a", "get /b"), run("get /a"), run("get /a")], key, [0, 1, 0])
    row = done.summary.first()
    assert (row["n_found"], row["n_missed"], row["errors"], row["recall"]) == (1, 1, 1, 0.5)
    assert column(evaluate.gate(None, done, 3), "rule") == ["errors"]


def test_checkpoints_fail_fast(spark, tmp_path):
    checkpoint.save(spark.range(3), str(tmp_path / "x"))
    assert checkpoint.load(spark, str(tmp_path / "x")).count() == 3
    (tmp_path / "bad.json").write_text('{"seq": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        checkpoint.load_json(spark, str(tmp_path / "bad.json"), "seq int").collect()
    assert checkpoint.load_timeline(spark, str(tmp_path / "bad.json")).count() == 1


def test_streams(spark, tmp_path):
    rows = candidates(spark, [{"symbol": "f", "evidence": "one", "severity": "LOW"}, {"symbol": "g", "pass_no": 2}, {"symbol": "f", "pass_no": 2, "evidence": "two"}, {"symbol": "f", "pass_no": 2, "evidence": "two"}])
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("pass_no") * 86400))
    for p in (1, 2):
        rows.where(f"pass_no = {p}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running.read(spark, str(tmp_path / "in"), rows.schema)
    query = running.keep_union(stream, str(tmp_path / "u")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    got = {r["symbol"]: (r["evidence"], r["severity"], r["n_rows"]) for r in running.kept_union(spark, str(tmp_path / "u"), last).collect()}
    assert got == {"f": ("one; two", "HIGH", 3), "g": ("", "HIGH", 1)}
    seen = running.first_seen(stream, "30 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    seen.awaitTermination()
    assert sorted(column(spark.table("seen"), "symbol")) == ["f", "g"]


def test_usage(spark):
    steps = spark.createDataFrame([("a", 0, 1.04), ("b", 1, 2.0), ("a", 2, 1.0), ("c", 3, 2.0)], "unit string, seq int, seconds double")
    assert [(r["unit"], r["seconds"]) for r in usage.slowest_units(steps, 2).collect()] == [("a", 2.0), ("b", 2.0)]


def test_live_run_converges_and_goes_on(spark, tmp_path):
    units = spark.createDataFrame([("u1", "one"), ("u2", "two")], "unit string, prompt string")
    replies = {"one": seams.reply_of([{"title": "T", "file": "a.py", "symbol": "f", "category": "x", "evidence": "e"}])}
    found, state = review_repository.live(units, {"m": seams.Canned(replies)}, ["auth"], str(tmp_path), effort="low")
    assert state == {"converged": False, "passes": 2, "errors": 0}  # one pass for its finding, one quiet one
    found, state = review_repository.live(units, {"m": seams.Canned({})}, ["auth"], str(tmp_path), effort="high")
    assert state == {"converged": True, "passes": 3, "errors": 0}
    assert [(r["title"], r["found_by"]) for r in found.collect()] == [("T", ["m"])]
    _, state = review_repository.live(units, {"m": seams.Canned({"one": None})}, ["auth"], str(tmp_path / "bad"), effort="low")
    assert state == {"converged": False, "passes": 2, "errors": 2}


def test_adversarial_rounds(spark, tmp_path):
    diffs = spark.createDataFrame([(0, "good"), (1, "broken"), (2, "moving")], "diff_id long, text string")
    item = {"file": "a.py", "line": 1, "category": "x"}
    other = {"file": "b.py", "line": 2, "category": "x"}
    finder = seams.Canned({}, seams.reply_of([item, other]))
    challenger = seams.Canned({"broken": json.dumps({"dismissed": ["a.py:1"], "findings": [{"file": "c.py", "category": "y"}], "mark": "broken"}), "moving": '{"mark": "moving"}'}, '{"mark": "good"}')
    judge = seams.Canned({"good": json.dumps({"agreed": True, "investigate": [], "findings": [item]}), "moving": json.dumps({"agreed": False, "investigate": [], "findings": [other]}), "broken": None})
    from siftstone.plans import adversarial

    done = adversarial.rounds(diffs, finder, challenger, judge, str(tmp_path))
    assert {r["diff_id"]: (r["rounds"], r["converged"], r["degraded"]) for r in done.status.collect()} == {0: (1, True, False), 1: (1, False, True), 2: (2, True, False)}
    assert sorted((r["diff_id"], r["file"]) for r in done.findings.collect()) == [(0, "a.py"), (1, "b.py"), (1, "c.py"), (2, "b.py")]


def test_retries():
    calls = []

    def provider(prompts):
        calls.append(list(prompts))
        if len(calls) == 1:
            raise OSError
        return ["ok" if len(calls) > 2 or p == "a" else None for p in prompts]

    assert seams.Retrying(provider, 2, 0.0)(["a", "b"]) == ["ok", "ok"]
    assert calls == [["a", "b"], ["a", "b"], ["b"]]


def test_notes_in_order(spark):
    from siftstone.operators import chunk, report
    from siftstone.sources.notes import guides, knowledge_refs, usable

    docs = spark.createDataFrame([("b", "---\nkind: language\n---\nB"), ("a", "---\nkind: framework\n---\nA"), ("c", "---\nkind: language\n---\nC")], "name string, text string")
    assert [(r["seq"], r["id"]) for r in guides(docs).collect()] == [(0, "b"), (1, "c"), (2, "a")]
    row = spark.range(1).select(knowledge_refs(F.array(F.lit("x")), F.array(F.lit("languages/go"))).alias("r"), usable(F.lit('{"a": 1}'), "a").alias("u"), usable(F.lit("{}")).alias("v"), report.shown(F.array(*map(F.lit, "abc")), 2).alias("s"), chunk.lens_header(F.lit(" ")).alias("l")).first()
    assert (row["r"], row["u"], row["v"], row["s"]) == (["vuln:x", "guide:languages/go"], True, False, "a, b ...")
    chosen = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "diff_id int, place int, vuln_id string")
    bodies = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, body string")
    assert select.bodies(chosen, bodies).first()["text"] == "A\n\nB"
    lists = spark.createDataFrame([(1, ["x", "y"]), (0, ["y", "z"])], "seq int, xs array<string>")
    assert column(select.flattened(lists, "xs"), "value") == ["y", "z", "x"]
    fragments = spark.createDataFrame([("u", "a.py", 4, 8), ("u", "a.py", 0, 3)], "unit string, file string, start int, end int")
    tree = files.from_list(spark, [("a.py", "one\ntwo\n")])
    assert chunk.gather_fragments(fragments, tree, ["unit"]).first()["text"] == "### a.py\n1 | one\n\n### a.py\n2 | two\n3 | "
    parts = spark.createDataFrame([(0, "template"), (1, "edited"), (2, " ")], "seq int, text string")
    assert chunk.shared_context(parts, spark.createDataFrame([("template",)], "text string")).first()["text"] == "edited"
