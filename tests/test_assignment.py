import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import score
from siftstone.plans import evaluate
from siftstone.queries import scoring

PAIRS = "target string, kind string, entry_seq long, id string, report_seq long, name string"


def greedy(rows):
    """Each entry in order takes its first free report, by plain loops."""
    out, taken = set(), set()
    for target, seq, entry in sorted({(r[0], r[2], r[3]) for r in rows}):
        mine = sorted((r[4], r[5]) for r in rows if (r[0], r[2], r[3]) == (target, seq, entry))
        free = next((name for _, name in mine if (target, name) not in taken), None)
        if free is not None:
            taken.add((target, free))
            out.add((target, entry, free))
    return out


def some(seed):
    rng = random.Random(seed)
    rows = []
    for target in ("t", "u"):
        n, m = rng.randint(1, 14), rng.randint(1, 14)
        share = rng.choice([0.1, 0.4, 1.0])
        rows += [(target, "planted", e % 5, f"k{e}", r, f"r{r % (m - 1 or 1)}") for e in range(n) for r in range(m) if rng.random() < share]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_rounds_and_reading_equal_the_loop(spark, seed):
    rows = some(seed)
    pairs = spark.createDataFrame(rows, PAIRS)
    for few in (10**6, 0):
        got = [tuple(r) for r in score.assign(pairs, few).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(rows)


@pytest.mark.parametrize("near", [True, False])
def test_a_large_target(spark, near):
    rng = random.Random(3)
    # reports anywhere: rounds find nearly all; reports near each entry: long chains are left
    rows = [("t", "planted", e, f"k{e:05}", r, f"r{r:05}") for e in range(3_000) for r in (sorted(rng.sample(range(max(0, e - 20), e + 20), 3)) if near else rng.sample(range(3_000), 3))]
    got = [tuple(r) for r in score.assign(spark.createDataFrame(rows, PAIRS), few=100).collect()]
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[5])
    taken, want = set(), set()
    for entry in sorted(by):
        free = next((n for n in sorted(by[entry]) if n not in taken), None)
        if free:
            taken.add(free)
            want.add(("t", entry, free))
    assert len(got) == len(set(got)) and set(got) == want


def test_entries_with_the_same_reports_take_one_round(spark, monkeypatch):
    rounds = []
    real = score.checkpointed
    monkeypatch.setattr(score, "checkpointed", lambda df: rounds.append(1) or real(df))
    rows = [("t", "planted", e, f"k{e:03}", r, f"r{r:03}") for e in range(80) for r in range(60)]
    got = {tuple(r) for r in score.assign(spark.createDataFrame(rows, PAIRS), few=0).collect()}
    assert got == {("t", f"k{i:03}", f"r{i:03}") for i in range(60)}
    assert len(rounds) <= 7


REPORT = "target string, seq int, name string, endpoint string, category string, files array<string>, text string"
KEY = "target string, kind string, seq int, id string, entry string, files array<string>, category string, symbols array<string>"


def of_classes(seed):
    """Reports and entries of a few contents; some names and ids are used again."""
    rng = random.Random(seed)
    reports, key = [], []
    for target in ("t", "u"):
        for i in range(30):
            name = f"r{rng.randint(0, 25)}" if i % 4 == 0 else f"s{i}"
            reports.append((target, i, name, rng.choice(["", "get /a", "get /b/*"]), "x", [rng.choice(["a.py", "b.py"])], rng.choice(["calls f", "calls g"])))
        for i in range(20):
            key.append((target, rng.choice(["planted", "planted", "safe"]), i, f"k{rng.randint(0, 15)}" if i % 5 == 0 else f"m{i}", rng.choice(["", "GET /a", "GET /b/<id>"]), [rng.choice(["a.py", "b.py"])], rng.choice(["", "x"]), rng.choice([[], ["f"]])))
    return reports, key


@pytest.mark.parametrize("seed", range(2))
def test_classes_give_the_pairs_assignment_and_outcomes(spark, seed):
    reports, key = of_classes(seed)
    r, k = spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY)
    pairs = [tuple(x) for x in score.match_pairs(r, k).collect()]
    assert pairs and len(pairs) == len(set(pairs))
    planted = [x for x in pairs if x[1] == "planted"]
    assert {tuple(x) for x in score.assign_classes(score.match_classes(r, k)).collect()} == greedy(planted)
    by_pairs = score.outcomes(r, k, spark.createDataFrame(pairs, PAIRS))
    assert sorted(map(tuple, score.outcomes(r, k).collect())) == sorted(map(tuple, by_pairs.collect()))


def test_rows_alike_are_one_link(spark):
    # 400 reports alike and 300 entries alike: 120,000 pairs, of one link
    r = spark.createDataFrame([("t", i, f"r{i}", "", "x", ["a.py"], "t") for i in range(400)], REPORT)
    k = spark.createDataFrame([("t", "planted", i, f"k{i}", "", ["a.py"], "x", []) for i in range(300)], KEY)
    assert score.match_classes(r, k).links.count() == 1
    assert score.match_pairs(r, k).count() == 120_000
    assert {(x["id"], x["name"]) for x in score.assign_classes(score.match_classes(r, k)).collect()} == {(f"k{i}", f"r{i}") for i in range(300)}


def test_rows_that_are_there_twice_keep_their_pairs(spark):
    reports = [("t", 0, "r0", "get /a", "x", ["a.py"], "calls f")] * 2 + [("t", 0, "r0", "", "x", ["a.py"], "calls f"), ("t", 1, "r1", "", "x", ["b.py"], "")]
    key = [("t", "planted", 0, "k0", "GET /a", ["a.py"], "", ["f"])] * 3 + [("t", "planted", 1, "k1", "", ["a.py"], "", ["f"])]
    r, k = spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY)
    names = [(x["id"], x["name"]) for x in score.match_pairs(r, k).collect()]
    # a pair for each two rows, however many ways they match
    assert sorted(names) == [("k0", "r0")] * 9 + [("k1", "r0")] * 3
    assert [tuple(x) for x in score.assign_classes(score.match_classes(r, k)).collect()] == [("t", "k0", "r0")]


def test_tiles_give_each_pair_once(spark, monkeypatch):
    reports, key = of_classes(3)
    reports, key = reports + reports[:20], key + key[:9]
    r, k = spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY)
    whole = sorted(map(tuple, score.match_pairs(r, k).collect()))
    monkeypatch.setattr(score, "TILE", 4)
    monkeypatch.setattr(score, "BLOCK", 2)
    monkeypatch.setattr(score, "PARTS", 1)
    got = score.match_pairs(r, k)
    # and the more pairs, the more tasks
    assert sorted(map(tuple, got.collect())) == whole and got.rdd.getNumPartitions() == -(-len(whole) // 32) > 4


def test_written_pairs_take_a_fraction_of_a_byte(spark, tmp_path):
    r = spark.createDataFrame([("t", i, f"r{i}", "", "x", ["a.py"], "t") for i in range(9_000)], REPORT)
    k = spark.createDataFrame([("t", "planted", i, f"k{i}", "", ["a.py"], "x", []) for i in range(200)], KEY)
    score.match_pairs(r, k).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1_800_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * 1_800_000


def test_parts_of_a_target_are_read_apart(spark):
    reports, key = of_classes(5)
    # more contents, of one target, that have nothing to do with one another
    reports += [("t", i, f"q{i}", "", "x", [f"f{i % 20}.py"], "") for i in range(100, 160)]
    key += [("t", "planted", i, f"p{i}", "", [f"f{i % 20}.py"], "x", []) for i in range(100, 140)]
    found = score.match_classes(spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY))
    whole = {tuple(x) for x in score.assign_classes(found).collect()}
    got = score.assign_classes(found, many=0).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(whole) and {tuple(x)[:3] for x in got} == whole
    assert len({x["task"] for x in got if x["id"].startswith("p")}) > 4


@pytest.mark.parametrize("rounds", [8, 1])
def test_what_hangs_together_has_one_number(spark, monkeypatch, rounds):
    monkeypatch.setattr(score, "ROUNDS", rounds)
    rng = random.Random(2)
    names = [f"c{i}" for i in rng.sample(range(1_000), 60)]
    rows = [("t", c, f"h{i + d}") for i, c in enumerate(names[:40]) for d in (0, 1)] + [("t", c, f"g{i // 2}") for i, c in enumerate(names[40:])] + [("u", c, "h") for c in names[:3]]
    got = {(x["target"], x["report_class"]): x["_part_of"] for x in score._hanging_together(spark.createDataFrame(rows, "target string, report_class string, hub string")).collect()}
    sets = [[("t", c) for c in names[:40]], *([("t", c) for c in names[i : i + 2]] for i in range(40, 60, 2)), [("u", c) for c in names[:3]]]
    numbers = [{got[x] for x in s} for s in sets]
    assert len(got) == 63 and all(len(n) == 1 for n in numbers)
    # a chain that one round doesn't shorten enough leaves its target whole
    assert len({min(n) for n in numbers[:-1]}) == (11 if rounds == 8 else 1)


def test_labels_are_dealt_out_and_contents_written_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, i % 3 // 2) for i in range(200)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    reports, key = scoring._reports(spark, str(tmp_path)), scoring._key(spark, str(tmp_path))
    assert min(reports.rdd.getNumPartitions(), key.rdd.getNumPartitions()) >= 32
    plans = []
    real = score.checkpointed
    monkeypatch.setattr(score, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    score.match_classes(reports, key)
    # contents and rows of each side; what matches is found in what was written
    assert [p.count("parquet") for p in plans] == [1, 1, 1, 1, 0]


def test_rows_without_a_target_have_no_outcome(spark):
    reports = [("t", 0, "r0", "", "x", ["a.py"], "f"), (None, 1, "r1", "", "x", ["a.py"], "f"), (None, 2, None, "", "x", [], "")]
    key = [("t", "planted", 0, "k0", "", ["a.py"], "x", []), (None, "planted", 1, "k1", "", ["a.py"], "x", []), (None, "safe", 2, None, "", [], "", [])]
    r, k = spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY)
    want = [("t", "k0", "found")]
    assert [tuple(x) for x in score.outcomes(r, k).collect()] == want
    assert [tuple(x) for x in score.outcomes(r, k, score.match_pairs(r, k)).collect()] == want


def test_all_runs_are_classed_at_once(spark, monkeypatch):
    reports, key = of_classes(7)
    r, k = spark.createDataFrame(reports, REPORT), spark.createDataFrame(key, KEY)
    calls = []
    real = score.match_classes
    monkeypatch.setattr(score, "match_classes", lambda *a: calls.append(1) or real(*a))
    runs = [r, r.where("seq % 3 > 0")]
    got = sorted(tuple(x) for x in evaluate.evaluate(runs, k).outcomes.select("target", "id", "outcome", "run").collect())
    assert len(calls) == 1
    assert got == sorted((*x, i) for i, part in enumerate(runs) for x in score.outcomes(part, k).select("target", "id", "outcome").collect())


def test_labels_of_any_quality_are_entries(spark, tmp_path):
    # of one target, file and symbol: 0 and 120 were no entries, nor was 180, safe
    spark.createDataFrame([(0, 0, 0), (60, 1, 0), (120, None, 0), (180, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["id"], r["outcome"]) for r in scoring.score_outcomes(spark, str(tmp_path)).collect()}
    assert got == {("k0", "found"), ("k60", "found"), ("k120", "found"), ("r180", "extra")}
    assert "quality" not in scoring.SQL["score_outcomes"] and "quality = 1" in scoring.SQL["score_match"]
