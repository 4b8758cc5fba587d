import json

import pytest

from siftstone import cli
from siftstone.plans import seams
from siftstone.sources import checkpoint

DIFF = "diff --git a/app.py b/app.py\n--- a/app.py\n+++ b/app.py\n+run(x)\n"
FOUND = seams.reply_of([{"title": "T", "file": "app.py", "line": 1, "severity": "HIGH", "category": "injection", "confidence": 0.9}])


def answering(prompts):
    """A model for the tests: finds one thing in what it is shown."""
    return [FOUND if "app.py" in p or "Code:" in p else '{"findings": []}' for p in prompts]


NAME = "tests.test_cli:answering"


@pytest.fixture
def diff(tmp_path):
    (tmp_path / "d.diff").write_text(DIFF)
    return str(tmp_path / "d.diff")


def test_diffs(spark, diff, capsys):
    assert cli.main(["review", "diff", "--file", diff, "--dry-run"]) == 0
    assert "no findings" in capsys.readouterr().out
    assert cli.main(["review", "diff", "--file", diff, "--provider", NAME, "--fail-on", "high"]) == 1
    assert "app.py:1" in capsys.readouterr().out
    assert cli.main(["review", "diff", "--file", diff, "--provider", NAME, "--fail-on", "critical", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["HIGH"] == 1
    assert cli.main(["review", "diff", "--file", diff, "--provider", NAME, "--exclude", "app"]) == 0
    assert cli.main(["review", "diff", "--file", diff]) == 2


def refuting(prompts):
    """A judge for the tests who lets nothing stay."""
    return [json.dumps({"agreed": True, "investigate": [], "findings": []}) for _ in prompts]


def test_provenance_is_in_every_format(spark, diff, tmp_path, capsys):
    (tmp_path / "meta.json").write_text(json.dumps({"address": "0xab", "contract_name": "Vault", "runs": ""}))
    base = ["review", "diff", "--file", diff, "--provider", NAME, "--source-meta", str(tmp_path / "meta.json")]
    target = {"address": "0xab", "contract_name": "Vault"}
    cli.main([*base, "--format", "json"])
    out = json.loads(capsys.readouterr().out)
    assert out["target"] == target and len(out["findings"]) == 1
    cli.main([*base, "--format", "sarif"])
    run = json.loads(capsys.readouterr().out)["runs"][0]
    assert run["properties"]["target"] == target and len(run["results"]) == 1
    for kind, head in (("text", "Target:\n"), ("markdown", "## Target\n\n")):
        cli.main([*base, "--format", kind])
        assert capsys.readouterr().out.startswith(f"{head}- address: 0xab\n- contract_name: Vault\n\n")
    assert cli.main([*base[:-1], str(tmp_path / "none.json")]) == 2


def test_each_seat_has_its_provider(spark, diff, capsys):
    base = ["review", "diff", "--file", diff, "--provider", NAME, "--mode", "adversarial", "--rounds", "1", "--format", "json", "--judge"]
    assert cli.main([*base, NAME]) == 0
    kept = len(json.loads(capsys.readouterr().out)["findings"])
    assert cli.main([*base, "tests.test_cli:refuting"]) == 0
    assert kept == 1 and json.loads(capsys.readouterr().out)["findings"] == []


def test_repositories(spark, tmp_path, capsys):
    root, place = tmp_path / "repo", str(tmp_path / "ws")
    (root / "services").mkdir(parents=True)
    (root / "routes.py").write_text("@route('/a')\ndef a(): pass\n")
    (root / "services" / "s.py").write_text("def s(): pass\n")
    base = ["review", "repository", str(root), "--workspace", place, "--domain", "web"]
    assert cli.main([*base, "--scaffold"]) == 0
    assert checkpoint.load(spark, f"{place}/worklist").collect()[0]["status"] == "open"
    assert cli.main([*base, "--gate"]) == 1
    assert cli.main([*base, "--run", "--provider", NAME, "--effort", "low"]) == 0
    state = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert state["errors"] == 0 and state["passes"] >= 2
    assert checkpoint.load(spark, f"{place}/worklist").collect()[0]["status"] == "reviewed"
    assert cli.main([*base, "--finalize", "--format", "markdown", "--fail-on", "high"]) == 1
    assert "1 findings" in capsys.readouterr().out and list((tmp_path / "ws" / "notes").glob("*.md"))
    cli.main([*base, "--gate"])
    assert "gate" in capsys.readouterr().out
    assert cli.main([*base, "--scaffold"]) == 0
    assert "earlier run" in capsys.readouterr().out
    assert cli.main([*base, "--scaffold", "--fresh"]) == 0
    with pytest.raises(SystemExit):
        cli.main([*base, "--scaffold", "--gate"])


def test_evaluations(spark, tmp_path, capsys):
    (tmp_path / "key.json").write_text(json.dumps({"planted": [{"id": "a", "file": "app.py", "category": "injection"}, {"id": "b", "entry": "GET /b"}]}))
    (tmp_path / "found.json").write_text(json.dumps({"findings": [{"title": "T", "file": "app.py", "line": 1, "category": "injection"}]}))
    out = str(tmp_path / "one")
    assert cli.main(["evals", "score", "t", "--key", str(tmp_path / "key.json"), "--findings-json", str(tmp_path / "found.json"), "--out", out]) == 1
    result = json.loads(capsys.readouterr().out)
    assert result["found"] == ["a"] and result["missed"] == ["b"] and result["recall"] == 0.5
    (tmp_path / "none.json").write_text("[]")
    other = str(tmp_path / "two")
    cli.main(["evals", "score", "t", "--key", str(tmp_path / "key.json"), "--findings-json", str(tmp_path / "none.json"), "--out", other])
    capsys.readouterr()
    assert cli.main(["evals", "compare", out, other]) == 0 and "newly missed: a" in capsys.readouterr().out
    assert cli.main(["evals", "gate", other, "--baseline", out]) == 1 and "gate FAIL" in capsys.readouterr().out
    assert cli.main(["evals", "gate", out, "--baseline", out]) == 0 and "gate PASS" in capsys.readouterr().out
    (tmp_path / "cases.jsonl").write_text(json.dumps({"name": "p", "diff": DIFF, "category": "injection"}) + "\n" + json.dumps({"name": "s", "diff": DIFF.replace("app", "safe")}) + "\n")
    assert cli.main(["evals", "diff", str(tmp_path / "cases.jsonl"), "--provider", NAME]) == 0
    assert json.loads(capsys.readouterr().out) == {"clean": 1, "found": 1}
    spark.createDataFrame([("vuln:a", "vulnerability", "a.md")], "ref string, kind string, path string").write.parquet(str(tmp_path / "items"))
    spark.createDataFrame([(["vuln:a"], True)], "refs array<string>, positive boolean").write.parquet(str(tmp_path / "cases"))
    spark.createDataFrame([("e", "b", ["vuln:zz"], True, "public")], "id string, benchmark string, refs array<string>, planted boolean, provenance string").write.parquet(str(tmp_path / "entries"))
    assert cli.main(["evals", "coverage", *(str(tmp_path / x) for x in ("items", "cases", "entries"))]) == 1
    assert "unresolved-reference" in capsys.readouterr().out


def test_queries_and_reports(spark, tmp_path, capsys):
    spark.createDataFrame([(0, "a.py", 1, "LOW", "c", "d", "", "", 0.5)], "seq long, file string, line int, severity string, category string, description string, exploit_scenario string, recommendation string, confidence double").write.parquet(str(tmp_path / "f"))
    assert cli.main(["report", "sarif", str(tmp_path / "f")]) == 0 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert cli.main(["report", "text", str(tmp_path / "f"), "--fail-on", "low"]) == 1
