"""Settings, responses, strict sources, workspaces and reading of trees."""

import os
import time

import pytest
from pyspark.sql import functions as F

from siftstone.functions import lines, replies
from siftstone.operators import chunk, filters, score, select, workspace
from siftstone.plans import review_repository, seams
from siftstone.session import shared_folder
from siftstone.sources import checkpoint, files, keys, payload
from tests.tables import column


def test_settings(spark):
    text = "# c\nexport A='x y'\nB = \"1\"\nnone\n=v\nC=\nA=2\nD='a\"\nE=p=q\r\nF= 'z' \n"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(replies.env_pairs(F.col("t")).alias("p")).collect()
    assert {r["key"]: r["value"] for r in got[0]["p"]} == {"A": "2", "B": "1", "C": "", "D": "'a\"", "E": "p=q", "F": "z"}
    assert got[1]["p"] == [] and got[2]["p"] is None


@pytest.mark.parametrize(("shape", "response", "text", "usage"), [
    ("messages", '{"content": [{"type": "text", "text": "a"}, {"text": "b"}, {"x": 1}], "usage": {"input_tokens": 3, "output_tokens": 4.0, "cache_read_input_tokens": "9"}}', "ab", (3, 4, 0, 0)),
    ("messages", '{"content": "plain"}', "plain", (0, 0, 0, 0)),
    ("chat", '{"choices": [{"message": {"content": ["a", {"text": "b"}]}}], "usage": {"prompt_tokens": 10, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 40}}}', "ab", (0, 2, 40, 0)),
    ("chat", '{"choices": []}', "", (0, 0, 0, 0)),
    ("envelope", ' {"result": "done"} ', "done", (0, 0, 0, 0)),
    ("envelope", ' [1] ', "[1]", (0, 0, 0, 0)),
    ("envelope", ' not json ', "not json", (0, 0, 0, 0)),
    ("responses", '{"usage": {"input_tokens": 10, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 4}}}', '{"usage": {"input_tokens": 10, "output_tokens": 2, "input_tokens_details": {"cached_tokens": 4}}}', (6, 2, 4, 0)),
])
def test_responses(spark, shape, response, text, usage):
    row = spark.createDataFrame([(response, shape)], "r string, s string").select(replies.reply_text(F.col("r"), F.col("s")).alias("t"), replies.token_usage(F.col("r"), F.col("s")).alias("u")).first()
    assert row["t"] == text and tuple(row["u"]) == usage


def test_strict_keys_and_cases(spark):
    key = lambda text: keys.answer_keys(spark.createDataFrame([("t", text)], "target string, text string"))
    rows = key('{"issues": [{"id": "a", "entry": "GET /a", "symbol": " Fn "}], "safe": [{"id": "s", "file": "x.py"}]}').collect()
    assert sorted((r["kind"], r["seq"], r["id"], r["files"], r["symbols"]) for r in rows) == [("planted", 0, "a", [], ["fn"]), ("safe", 0, "s", ["x.py"], [])]
    for bad in ("{}", '{"planted": [{"id": "a"}]}', '{"planted": [{"entry": "x"}]}', "not json"):
        with pytest.raises(Exception, match="answer key needs|no id|no location"):
            key(bad).collect()
    case = lambda *texts: keys.cases(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert case('{"name": "a", "diff": "d", "knowledge": ["k"]}').first()["domain"] == "web"
    with pytest.raises(ValueError, match="twice"):
        case('{"name": "a", "diff": "d"}', '{"name": "a", "diff": "e"}')
    with pytest.raises(Exception, match="no diff"):
        case('{"name": "a"}').collect()


def test_payloads_are_checked(spark, tmp_path):
    check = lambda text: payload.checked(spark.createDataFrame([("0x", text)], "address string, payload string")).collect()
    assert check('{"status": "1", "result": [{"SourceCode": "x", "ContractName": "C"}]}')[0]["contract_name"] == "C"
    for bad, why in (("[]", "JSON object"), ('{"status": "0", "result": "limit"}', "limit"), ('{"status": "1", "result": []}', "no source"), ('{"status": "1", "result": [{"SourceCode": ""}]}', "not verified")):
        with pytest.raises(Exception, match=why):
            check(bad)
    tree = files.from_list(spark, [("a/b.sol", "B"), ("c.sol", "C")])
    assert payload.write_tree(tree, str(tmp_path / "out")) == 2 and (tmp_path / "out" / "a" / "b.sol").read_text() == "B"
    with pytest.raises(ValueError, match="unsafe"):
        payload.write_tree(files.from_list(spark, [("../x", "B")]), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    assert payload.provenance(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        payload.provenance(spark, str(tmp_path / "bad.json"))


def test_workspaces(spark, tmp_path):
    place = str(tmp_path / "ws")
    assert checkpoint.clear(spark, place) == [] and not checkpoint.has_prior_run(spark, place)
    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "note.txt").write_text("mine")
    with pytest.raises(ValueError, match="no workspace"):
        checkpoint.clear(spark, place)
    checkpoint.mark(spark, place)
    assert "note.txt" in checkpoint.clear(spark, place)
    assert os.listdir(place) == []


def test_invariants_never_overwrite_an_edit():
    assert workspace.imported_invariants(None, "T", None) == ("T", "")
    assert workspace.imported_invariants("mine", "T", None) == ("mine", "")
    assert workspace.imported_invariants("T", "T", "new")[0] == "new"
    assert workspace.imported_invariants("mine", "T", "new")[0] == "mine"
    assert "match" in workspace.imported_invariants("new", "T", "new")[1]


def test_tree_leaves_out_links_that_lead_away(spark, tmp_path):
    (tmp_path / "out.py").write_text("secret")
    root = tmp_path / "repo"
    (root / "a[1]").mkdir(parents=True)
    (root / "a[1]" / "x y.py").write_text("ok")
    (root / "in.py").symlink_to(root / "a[1]" / "x y.py")
    (root / "away.py").symlink_to(tmp_path / "out.py")
    (root / "large.py").write_text("x" * (files.MAX_BYTES + 1))
    got = {r["path"]: r["text"] for r in files.read_tree(spark, str(root)).collect()}
    assert got == {"a[1]/x y.py": "ok", "in.py": "ok", "large.py": ""}
    assert files.read_tree(spark, str(root), {"skip_dir": ["a[1]"], "skip_root_dir": []}).count() == 2


def test_a_call_beyond_the_deadline_has_failed():
    slow = seams.Retrying(lambda ps: time.sleep(5) or ["late"] * len(ps), retries=0, deadline=0.2)
    assert slow(["a", "b"]) == [None, None]
    replies_ = iter([["", None], ["x", "y"]])
    assert seams.Retrying(lambda _: next(replies_), retries=1, wait=0.0)(["a", "b"]) == ["x", "y"]


def test_domains(spark):
    assert filters.domain("web") == "web" and filters.domain("auto") == "web"
    assert filters.domain("auto", spark.createDataFrame([("a.sol",)], "path string")) == "evm"
    with pytest.raises(ValueError, match="unknown domain"):
        filters.domain("move")
    with pytest.raises(ValueError, match="unknown seat"):
        chunk.seat_prompt("clerk", F.lit("x"))


def test_many_needles_go_in_parts(spark):
    texts = spark.createDataFrame([(i, f"a w{i} b w{i + 1}.") for i in range(30)], "id long, text string")
    needles = spark.createDataFrame([(f"w{i}",) for i in range(40)] + [("w1",), ("",)], "needle string")
    whole = {tuple(r) for r in select.contained(texts, needles).select("id", "needle").collect()}
    assert {tuple(r) for r in select.contained(texts, needles, limit=7).select("id", "needle").collect()} == whole
    assert whole == {(i, f"w{j}") for i in range(30) for j in range(40) if f"w{j}" in f"a w{i} b w{i + 1}."}


def test_long_diffs_and_texts(spark):
    """100,000 files in one diff, 60,000 lines in one text: folds that gather little."""
    began = time.time()
    rows = spark.range(100_000).select(F.lit("d").alias("g"), F.col("id").alias("seq"), (F.col("id") % 700 + 1).alias("size"))
    got = chunk.pack(rows, "g")
    sizes = got.join(rows, "seq").groupBy("batch").agg(F.sum("size").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("k")).orderBy("batch").collect()
    assert sum(r["k"] for r in sizes) == 100_000 and all(r["n"] <= chunk.BATCH and r["b"] - r["a"] + 1 == r["k"] for r in sizes)
    assert all(a["b"] + 1 == b["a"] and a["n"] + b["a"] % 700 + 1 > chunk.BATCH for a, b in zip(sizes, sizes[1:], strict=False))
    text = spark.createDataFrame([("x" * 5 + "\n" + " y\n") * 30_000], "string").select(lines.boundaries(F.col("value")).alias("b")).first()["b"]
    assert text == [9 * i for i in range(30_000)] + [270_000] or text == [9 * i for i in range(30_000)]
    assert time.time() - began < 60


def test_entries_need_only_as_many_names_as_their_rank(spark):
    rows = [("t", "planted", e, f"k{e}", r, f"r{r}") for e in range(12) for r in range(40)]
    pairs = spark.createDataFrame(rows, "target string, kind string, entry_seq int, id string, report_seq int, name string")
    assert {r["id"]: r["name"] for r in score.assign(pairs).collect()} == {f"k{e}": f"r{e}" for e in range(12)}


def test_gate_and_coverage_texts(spark):
    none = spark.createDataFrame([], "rule string, detail string")
    assert column(workspace.gate_text(none, "x"), "text") == ["gate PASS: x"]
    assert column(workspace.gate_text(spark.createDataFrame([("b", "2"), ("a", "1")], "rule string, detail string"), "x"), "text") == ["gate FAIL: x, 2 blocking\n  - a: 1\n  - b: 2"]


def test_a_shared_folder_is_asked_of_clusters(spark):
    assert shared_folder(spark)


def test_a_kept_union_is_folded_now_and_then(spark, tmp_path):
    """A stream of eleven files, a batch each: three bases, the rows before the last but one gone, the union that of all rows."""
    from siftstone.operators import union
    from siftstone.streaming import running
    from tests.tables import candidates

    place, source = str(tmp_path / "u"), str(tmp_path / "in")
    for n in range(11):
        rows = candidates(spark, [{"seq": 10 * n + i, "line": i % 3, "severity": "HIGH" if n % 2 else "LOW", "evidence": f"e{n % 4}"} for i in range(4)])
        rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    everything = spark.read.parquet(source)
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(source)
    running.keep_union(stream, place, every=3).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(int, os.listdir(f"{place}/base"))) == [6, 9] and min(map(int, os.listdir(f"{place}/rows"))) > 0
    shape = lambda df: sorted((r["key"], r["severity"], sorted(r["evidence"].split("; ")), r["n_rows"], r["seq"]) for r in df.collect())
    assert shape(running.kept_union(spark, place, 10, every=3)) == shape(union.fold(everything))


@pytest.mark.parametrize("seed", range(3))
def test_units_of_a_hub_against_a_plain_fold(spark, seed):
    import random

    from siftstone.operators import callgraph

    rng = random.Random(seed)
    sizes = {f"f{i}": rng.choice([0, 1, 3, 7, 7, 7, 20, 90]) for i in range(120)}
    functions = spark.createDataFrame([("c", n, "a.sol", 0, s, n == "f0") for n, s in sizes.items()], "contract string, fn string, file string, start int, `end` int, risky boolean")
    edges = [(f"f{i}", "f0", i) for i in range(1, 120) if rng.random() < 0.8]
    calls = spark.createDataFrame([("c", a, b, s) for a, b, s in edges], "contract string, caller string, callee string, seq int")
    got = callgraph.call_path_units(functions, calls, F.col("risky"), cap=60).first()
    total, taken = sizes["f0"], ["f0"]
    for caller, _, _ in sorted(edges, key=lambda e: (e[2], e[0])):
        if total + sizes[caller] <= 60:
            total, taken = total + sizes[caller], [*taken, caller]
    assert got["fns"] == sorted(taken) and got["chars"] == total


def test_a_replacement_that_broke_off_is_ended(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "t")
    number = lambda: sorted(r["id"] for r in checkpoint.load(spark, place).collect())
    checkpoint.save(spark.range(2), place)
    checkpoint.replace(checkpoint.load(spark, place).where("id > 0"), place)
    assert number() == [1] and not (tmp_path / "t-next").exists() and not (tmp_path / "t-old").exists()
    # the new table isn't whole: the old one stands
    checkpoint.save(spark.range(5), f"{place}-next")
    (tmp_path / "t-next" / "_SUCCESS").unlink()
    assert number() == [1]
    # the old one has moved out: the new one is taken
    checkpoint.save(spark.range(3), f"{place}-next")
    os.rename(place, f"{place}-old")
    assert checkpoint.exists(spark, place) and number() == [0, 1, 2] and not (tmp_path / "t-old").exists()


def test_a_run_that_goes_on_reads_keys_only(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", f"p{i}") for i in range(4)], "unit string, prompt string")
    model = seams.Canned({"p0": seams.reply_of([{"title": "T", "file": "a.py", "symbol": "f", "category": "x"}, {"title": "T", "file": "b.py", "symbol": "g", "category": "x"}])})
    found, state = review_repository.live(units, {"m": model}, ["a", "b"], str(tmp_path), effort="low")
    assert state == {"converged": True, "passes": 3, "errors": 0} and found.count() == 2
    assert [spark.read.parquet(f"{tmp_path}/pass-{i:04d}/new_keys").count() for i in (1, 2, 3)] == [2, 0, 0]
    again, same = review_repository.live(units, {"m": seams.Canned({})}, ["a", "b"], str(tmp_path), effort="low")
    assert same == state and again.count() == 2
