from pyspark.sql import functions as F

from siftstone.operators import callgraph, chunk, compare, coverage, dedup, filters, gate, passes, report, resolve, score, union, verify
from siftstone.sources.rules import DEFAULT
from tests.tables import candidates, column, findings


def keys(spark, rows, by_file=False):
    return len(set(column(candidates(spark, rows).select(union.candidate_key(by_file).alias("k")), "k")))


def test_candidate_keys(spark):
    assert keys(spark, [{"endpoint": "GET /withdrawals/<wid>"}, {"endpoint": "get /withdrawals/{id}"}]) == 1
    assert keys(spark, [{"symbol": "liquidate"}, {"symbol": "Vault.liquidate"}], True) == 1
    assert keys(spark, [{"endpoint": "verify"}, {"endpoint": "verify"}, {}], True) == 2
    assert keys(spark, [{"line": 1}, {"line": 2}, {}]) == 3
    assert keys(spark, [{"endpoint": "x", "file": "a"}, {"endpoint": "x", "file": "b"}]) == 1
    assert keys(spark, [{"endpoint": "x", "file": "a"}, {"endpoint": "x", "file": "b"}], True) == 2


def test_fold_keeps_evidence_in_order(spark):
    rows = [{"symbol": "f", "evidence": "one", "severity": "LOW", "found_by": ["b"]}, {"symbol": "f", "evidence": "two", "severity": "HIGH", "status": "confirmed", "found_by": ["a"]}, {"symbol": "f", "evidence": "one", "severity": "MEDIUM", "found_by": ["a"]}, {"symbol": "f", "evidence": "n"}]
    row = union.fold(candidates(spark, rows)).first()
    assert (row["evidence"], row["status"], row["found_by"], row["severity"], row["n_rows"]) == ("one; two", "confirmed", ["a", "b", "m"], "HIGH", 4)


def test_collapse_needs_a_line(spark):
    rows = [{"line": 58, "category": "replay", "endpoint": "x"}, {"line": 58, "category": "Replay", "endpoint": "y"}, {}, {}, {"file": "", "line": 58}, {"file": "", "line": 58}]
    assert sorted(column(dedup.collapse_colocated(candidates(spark, rows)), "seq")) == [0, 2, 3, 4, 5]


def converged(spark, new, clean):
    table = spark.createDataFrame([(i + 1, n) for i, n in enumerate(new) if n], "pass_no int, n_new long")
    state = passes.convergence(table, spark.createDataFrame([(i + 1, c) for i, c in enumerate(clean)], "pass_no int, clean boolean"))
    return [r["pass_no"] for r in state.where("converged").collect()]


def test_convergence(spark):
    assert converged(spark, [1, 0, 0], [True] * 3) == [3]
    assert converged(spark, [1, 0, 0, 0, 0], [True, False, False, True, True]) == [5]


def test_filter_reasons(spark):
    rows = findings(spark, [{"confidence": 0.49}, {"confidence": 0.5}, {"file": "tests/a.py"}, {"file": "gen/a.py"}, {"file": "tests/a.py", "confidence": 0.1}])
    kept, dropped = filters.filter_findings(rows, DEFAULT, ["gen/"])
    assert column(kept, "seq") == [1]
    assert {r["seq"]: r["reason"] for r in dropped.collect()} == {0: "low confidence", 2: "test path", 3: "excluded path", 4: "low confidence"}


def test_path_classes(spark):
    paths = ["lib/a.py", "src/lib/a.py", "x/node_modules/a.py", "a/tests/b.py", "Test_a.py", "README.MD", "go.sum", "db/x.sql", "a\\tests\\b.py", "tests"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", filters.is_noise(F.col("p"), DEFAULT).alias("x"))
    assert {r["p"]: r["x"] for r in df.collect()} == dict(zip(paths, [True, False, True, True, True, True, True, False, True, False], strict=True))


def test_domain(spark):
    of = lambda paths: filters.domain_of(spark.createDataFrame([(p,) for p in paths], "path string")).first()["domain"]
    assert of(["a.sol", "b.py"]) == "evm"
    assert of(["a.sol", "b.py", "c.py"]) == "web"


def test_severity_gate(spark):
    rows = findings(spark, [{"severity": "HIGH"}])
    assert [filters.severity_gate(rows, t).first()["failed"] for t in ("critical", "high", "low", None, "x")] == [False, True, True, False, False]
    assert filters.severity_gate(rows.limit(0), "low").first()["failed"] is False


def test_resolve(spark):
    files = spark.createDataFrame([("a/x.py",), ("b/x.py",), ("a/y.py",)], "path string")
    refs = spark.createDataFrame([("a/x.py",), ("x.py",), ("y.py",), ("q/y.py",), ("../a/y.py",), ("z.py",)], "file string")
    assert {r["file"]: r["resolved"] for r in resolve.resolve_paths(refs, files).collect()} == {"a/x.py": "a/x.py", "x.py": None, "y.py": "a/y.py", "q/y.py": "a/y.py", "../a/y.py": None, "z.py": None}


def test_pack(spark):
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([30, 40, 100, 10, 20, 70, 200, 1])], "g string, seq long, size long")
    assert [b for _, b in sorted((r["seq"], r["batch"]) for r in chunk.pack(rows, "g", cap=100).collect())] == [0, 0, 1, 2, 2, 2, 3, 4]


def test_diff_split(spark):
    rows = spark.createDataFrame([(0, "diff --git a/x b/x\n+1\ndiff --git a/y b/y\n+2\n"), (1, "no header"), (2, " \n")], "id int, diff string")
    assert [(r["id"], r["chunk_no"], r["path"]) for r in chunk.split_diff(rows).orderBy("id", "chunk_no").collect()] == [(0, 0, "x"), (0, 1, "y"), (1, 0, "")]


def test_budget_keeps_the_part_that_crosses_it(spark):
    rows = spark.createDataFrame([("g", i, 40) for i in range(5)], "g string, seq int, size int")
    assert sorted(column(chunk.within_budget(rows, ["g"], ["seq"], "size", 100, 50), "seq")) == [0, 1, 2]


def test_call_paths(spark):
    functions = spark.createDataFrame([("c", f, "c.sol", 0, n, r) for f, n, r in (("a()", 10, True), ("b()", 95, False), ("d()", 50, False), ("e()", 5, True), ("f()", None, True))], "contract string, fn string, file string, start int, end int, risky boolean")
    calls = spark.createDataFrame([("c", "a()", "b()", 0), ("c", "a()", "d()", 1), ("c", "e()", "a()", 0), ("c", "a()", "a()", 2)], "contract string, caller string, callee string, seq int")
    units = callgraph.call_path_units(functions, calls, F.col("risky"), 100)
    assert {r["anchor"]: r["fns"] for r in units.collect()} == {"a()": ["a()", "d()", "e()"], "e()": ["a()", "e()"]}
    assert column(callgraph.without_contained(units, ["contract", "anchor"]), "anchor") == ["a()"]


def votes(spark, rows):
    return spark.createDataFrame(rows, "key string, vote_no int, completed boolean, real boolean, reason string")


def test_verdicts(spark):
    rows = [("none", 0, False, False, ""), ("saved", 0, True, False, "x"), ("saved", 1, True, True, ""), ("dropped", 0, True, False, "why"), ("dropped", 1, False, False, ""), ("unheld", 0, True, False, "y"), ("broken", 0, True, False, "z"), ("alone", 0, True, False, "z")]
    held = spark.createDataFrame([("dropped", "", True, True), ("unheld", "", True, True), ("unheld", "m", True, False), ("broken", "", True, True), ("broken", "m", False, False)], "key string, label string, completed boolean, holds boolean")
    got = {r["key"]: (r["real"], r["incomplete"], r["errors"], r["reason"]) for r in verify.verdicts(votes(spark, rows), held).collect()}
    assert got == {"none": (True, True, 1, ""), "saved": (True, False, 0, ""), "dropped": (False, False, 1, "why"), "unheld": (True, False, 0, ""), "broken": (True, True, 1, ""), "alone": (True, False, 0, "")}


def test_skeptic_needs_the_file_that_it_cites(spark):
    df = spark.createDataFrame([(True, False, ["`a.py:3`"], ["x/a.py"]), (True, False, ["b.py"], ["x/a.py"]), (True, True, None, []), (False, None, None, []), (True, False, ["y/a.py"], ["x/a.py"])], "parsed boolean, real boolean, controls array<string>, shown array<string>")
    assert column(df.select(verify.skeptic_verdict(*map(F.col, df.columns)).alias("x")), "x") == [False, True, True, None, True]


REPORT = "target string, seq int, name string, endpoint string, category string, files array<string>, text string, lines array<int>"
KEY = "target string, kind string, seq int, id string, entry string, files array<string>, category string, symbols array<string>"


def test_scoring(spark):
    reports = spark.createDataFrame([("t", 0, "r-hit", "get /a/*", "x", ["a.py"], "t", []), ("t", 1, "r-fp", "get /b", "idor", ["b.py"], "t", []), ("t", 2, "r-extra", "get /c", "y", ["c.py"], "t", []), ("t", 3, "r-dup", "get /a/*", "x", ["a.py"], "t", [])], REPORT)
    key = spark.createDataFrame([("t", "planted", 0, "hit", "GET /a/<id>", ["a.py"], "x", []), ("t", "planted", 1, "miss", "GET /z", ["z.py"], "x", []), ("t", "safe", 0, "like", "GET /b", [], "idor", []), ("t", "safe", 1, "other", "GET /c", [], "idor", [])], KEY)
    rows = score.outcomes(reports, key)
    assert {(r["id"], r["outcome"]) for r in rows.collect()} == {("hit", "found"), ("miss", "missed"), ("r-fp", "false_positive"), ("r-extra", "extra"), ("r-dup", "extra")}
    got = score.summary(rows).first()
    assert (got["recall"], got["precision_known"], got["clean"]) == (0.5, 0.5, False)


def test_symbols_are_whole_tokens(spark):
    entry = ("t", "planted", 0, "k", "", ["src/a.py"], "allow", ["approve"])
    reports = spark.createDataFrame([("t", 0, "no", "", "allow", ["x/a.py"], "approved allowance", []), ("t", 1, "yes", "", "other", ["x/a.py"], "approve skips", [])], REPORT)
    assert column(score.match_pairs(reports, spark.createDataFrame([entry], KEY)), "name") == ["yes"]


def test_one_report_is_one_finding(spark):
    reports = spark.createDataFrame([("t", 0, "r", "get /a", "x", ["a.py"], "", []), ("t", 1, "s", "get /a", "x", ["a.py"], "", [])], REPORT)
    key = spark.createDataFrame([("t", "planted", i, f"k{i}", "GET /a", [], "x", []) for i in range(3)], KEY)
    assert sorted((r["id"], r["name"]) for r in score.assign(score.match_pairs(reports, key)).collect()) == [("k0", "r"), ("k1", "s")]


def test_run_fold(spark):
    found = [("a", "b"), ("a", "b"), ("a", "c")]
    rows = [("t", run, i, "found" if i in f else "missed") for run, f in enumerate(found) for i in "abc"] + [("t", 1, "x", "false_positive")]
    folded = score.fold_runs(spark.createDataFrame(rows, "target string, run int, id string, outcome string"))
    heads = spark.createDataFrame([("t", i, 2, int(i == 2)) for i in range(3)], "target string, run int, n_reports int, errors int")
    got = score.folded_summary(folded, heads).first()
    assert (got["n_found"], got["n_missed"], got["n_fp"], got["errors"], got["recall"]) == (2, 1, 0, 1, 0.6667)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "id string, outcome string")


def test_compare(spark):
    before, after = outcomes(spark, [("a", "found")]), outcomes(spark, [("a", "found"), ("b", "found"), ("fp", "false_positive")])
    assert {(r["id"], r["flip"]) for r in compare.flips(before, after).collect()} == {("b", "newly_found"), ("fp", "newly_false_positive")}
    rate = lambda n: spark.createDataFrame([("a", n, 3)], "id string, found int, runs int")
    moved = compare.catch_rate_moves(rate(3), rate(2), compare.flips(before, before)).first()
    assert (moved["rate_before"], moved["rate_after"]) == (1.0, 0.667)


def test_regression_gate(spark):
    before, after = outcomes(spark, [("a", "found"), ("b", "found")]), outcomes(spark, [("a", "found"), ("fp", "false_positive"), ("e", "extra")])
    rules = lambda *a: sorted(column(compare.regression_gate(*a), "rule"))
    assert rules(before, after, F.lit(0), F.lit(0.5), 0.8) == ["new false positive", "newly missed", "precision below floor"]
    assert rules(before, before, F.lit(2), F.lit(1.0), 0.0) == ["errors"]
    assert rules(before, before.union(outcomes(spark, [("e", "extra")])), F.lit(0), F.lit(1.0), 0.8) == []


def test_coverage(spark):
    items = spark.createDataFrame([("vuln:a", "vulnerability"), ("vuln:b", "vulnerability"), ("guide:x", "guide")], "ref string, kind string")
    cases = spark.createDataFrame([(["vuln:a"], True), (["vuln:a", "guide:x"], False)], "refs array<string>, positive boolean")
    entries = spark.createDataFrame([("e", "b", ["vuln:a", "vuln:gone"], True, "private"), ("f", "b", [], False, "public")], "id string, benchmark string, refs array<string>, planted boolean, provenance string")
    cov = coverage.matrix(items, coverage.uses(cases, entries))
    assert {r["ref"]: tuple(r)[2:] for r in cov.collect()} == {"vuln:a": (1, 1, 1, 0, 2, 1), "vuln:b": (0, 0, 0, 0, 0, 0), "guide:x": (0, 1, 0, 0, 1, 0)}
    manifests = spark.createDataFrame([("b", ["guide:x"])], "id string, refs array<string>")
    got = sorted((r["kind"], r["ref"]) for r in coverage.problems(cov, coverage.referenced(manifests, entries), entries).collect())
    assert got == [("entry-without-knowledge", "f"), ("missing-positive", "vuln:b"), ("missing-repository-target", "vuln:b"), ("missing-safe", "vuln:b"), ("unresolved-reference", "vuln:gone")]


def test_gate(spark):
    units = spark.createDataFrame([("a", "Reviewed"), ("b", "open")], "unit string, status string")
    graded = spark.createDataFrame([("c", "High"), ("d", None)], "name string, risk string")
    checks = gate.completeness(units, graded, 1, True)
    assert {r["check"]: r["n"] for r in checks.collect()} == {"surface enumerated": 0, "units exist": 0, "units reviewed": 1, "candidates graded": 1, "run converged": 0}
    assert gate.passed(checks).first()["passed"] is False
    assert gate.passed(gate.completeness(units.limit(1), graded.limit(1), 1, True)).first()["passed"] is True


def test_unowned_paths_stand_anywhere(spark):
    inventory = spark.createDataFrame([(p,) for p in ("a/x.py", "b/y.py", "c/z.py", "d.py")], "path string")
    artifacts = spark.createDataFrame([("see `a/x.py:12`",), ("prefix/b/y.pyc and d.py",), ("an a b.py",), (None,)], "text string")
    assert column(gate.unowned(inventory, artifacts), "path") == ["c/z.py"]
    odd = inventory.union(spark.createDataFrame([("a b.py",), ("c d.py",), ("q",), ("",)], "path string"))
    assert sorted(column(gate.unowned(odd, artifacts), "path")) == ["", "c d.py", "c/z.py", "q"]


def test_reports(spark):
    rows = findings(spark, [{"severity": "LOW", "file": "b.py"}, {"severity": "CRITICAL", "category": ""}, {"severity": "LOW", "file": "", "category": "gone"}, {"severity": "HIGH", "category": "idor", "line": None}])
    import json

    log = json.loads(report.as_sarif(rows).first()["report"])
    run = log["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["security", "idor", "replay"]
    assert [(r["ruleIndex"], r["level"]) for r in run["results"]] == [(0, "error"), (1, "error"), (2, "note")]
    assert "region" not in run["results"][1]["locations"][0]["physicalLocation"]
    data = json.loads(report.as_json(rows).first()["report"])
    assert data["summary"] == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 2} and len(data["findings"]) == 4
    assert report.as_text(rows.limit(0)).first()["report"] == "no findings"
    by_class = {r["category"]: json.loads(r["report"]) for r in report.as_sarif(rows, ["category"]).collect()}
    assert by_class.keys() == {"", "idor", "replay"} and all(len(x["runs"][0]["tool"]["driver"]["rules"]) == 1 for x in by_class.values())
    assert report.as_markdown(rows).first()["report"].startswith("# Review: 4 findings (1 CRITICAL, 1 HIGH, 2 LOW)")


def test_names_are_unique(spark):
    rows = candidates(spark, [{"category": "x", "line": 1}, {"category": "x", "line": 1, "severity": "CRITICAL"}, {"category": "x-2", "line": 1}])
    got = report.finding_names(rows)
    assert len(set(column(got, "name"))) == 3 and {r["seq"]: r["name"] for r in got.collect()}[1] == "a-py-1-x"
