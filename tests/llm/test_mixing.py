import random
from collections import defaultdict

from pyspark.sql import functions as F

from siftstone.llm import mixing

DOCS = "doc_id long, text string, source string, size string, id int, n int"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, "z", 1, 2) for k, t, s in rows], DOCS)


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    return [(i, "w " * min(400, int(rng.lognormvariate(3, 1)) + 1), rng.choice(["hot"] * 6 + ["a", "é", "z", None])) for i in range(n)]


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > cap * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: cap * sizes[s] for s in above}
        open_ -= above
    return out


def test_targets_against_rounds(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 2, None: 30}, {"a": 1000, "b": 0, "c": 1}, {None: 5}, {"x": 0}, {"é": 10, "z": 500, "Z": 20, "a": 7, "b": 9}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_each_source_comes_near_its_target(spark):
    rows = corpus()
    got = mixing.mixed(docs(spark, rows), group=16).collect()
    source = {k: s for k, _, s in rows}
    taken, target, largest, sizes = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["copies"] * r["size"]
        target[s], largest[s] = r["target"], max(largest[s], r["size"])
        sizes[s] += r["size"]
        assert 0 <= r["copies"] <= 3
    assert len(got) == len(rows) and all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    want = targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in want)
    assert all(abs(taken[s] - target[s]) < largest[s] for s in target)
    again = mixing.mixed(docs(spark, rows[::-1]).repartition(7), group=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_expectations_are_kept(spark):
    """A document's chance is its fraction, whatever its size: over many groups the mean comes near it."""
    rng = random.Random(1)
    items = spark.createDataFrame([(f"s{i // 40}", rng.choice([1, 5, 50]), i, 1, 0.3) for i in range(4000)], "source string, size long, id long, n long, p double")
    got = mixing.rounded(items).join(items.select("id", "size"), "id").groupBy("size").agg(F.avg("p").alias("p")).collect()
    assert len(got) == 3 and all(abs(r["p"] - 0.3) < 0.05 for r in got)


def test_sure_and_impossible_items_stay(spark):
    items = spark.createDataFrame([("s", 2, i, 1, p) for i, p in enumerate([0.0, 1.0, 0.5, 0.5])], "source string, size long, id long, n long, p double")
    got = {r["id"]: r["p"] for r in mixing.rounded(items).collect()}
    assert got[0] == 0 and got[1] == 1 and got[2] + got[3] == 1


def test_odd_documents(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y", None), (4, "x " * 30_000, "b"), (5, "q w e", "b"), (5, "q w e", "b"), (5, "q w e", "b"), (6, "solo", "c")]
    got = mixing.mixed(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["copies"] for r in got if r["size"] == 0} == {0}
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_each_document_keeps_its_chance(spark):
    """The same documents in many sources: each one is taken about as often as its chance, and the words taken stay near the target."""
    sizes, sources = [1, 2, 3, 5, 8, 13, 40, 400], 600
    items = spark.createDataFrame([(f"s{k}", n, 1000 * k + i, 0, 0.37) for k in range(sources) for i, n in enumerate(sizes)], "source string, size long, id long, n long, p double")
    got = mixing.rounded(items).collect()
    taken = defaultdict(float)
    words = defaultdict(float)
    for r in got:
        taken[r["id"] % 1000] += r["p"] / sources
        words[r["id"] // 1000] += r["p"] * sizes[r["id"] % 1000]
    assert len(got) == len(items.collect()) and all(abs(taken[i] - 0.37) < 0.08 for i in range(len(sizes)))
    target = 0.37 * sum(sizes)
    assert abs(sum(words.values()) / sources - target) < 0.1 * target
    assert all(abs(w - target) < max(sizes) for w in words.values())


def fold(items, level, draw):
    """Pairs of single documents, one after the other, by the definition: what one side gains the other loses, until one is 0 or 1."""
    left, done = None, {}
    for key, size, p in items:
        if left is None:
            left = [key, size, p]
            continue
        k, a, q = left
        up, down = min(a * (1 - q), size * p), min(a * q, size * (1 - p))
        if draw(level, k, key) * (up + down) < down:
            q, p = q + up / a, p - up / size
        else:
            q, p = q - down / a, p + down / size
        open_ = []
        for k_, n, x in ((k, a, q), (key, size, p)):
            if min(abs(x), abs(x - 1)) < 1e-9:
                done[k_] = float(round(x))
            else:
                open_.append([k_, n, x])
        left = open_[0] if open_ else None
    return left, done


def test_pairs_against_plain_loops(spark):
    rng = random.Random(9)
    for case in range(6):
        items = [((i, 10 + i), rng.choice([1, 2, 5, 9]), rng.choice([0.2, 0.5, 0.9])) for i in range(rng.randint(1, 25))]
        pairs = spark.createDataFrame([(2, *a[0], *b[0]) for a in items for b in items], "level int, a long, b long, c long, d long")
        draws = {((r["a"], r["b"]), (r["c"], r["d"])): r["u"] for r in pairs.withColumn("u", mixing.unit_hash(F.lit(2), "a", "b", "c", "d")).collect()}
        rows = spark.createDataFrame([([(n, 0.0, k[0], k[1], p) for k, n, p in items],)], f"items array<{mixing.ITEM}>")
        got = rows.select(mixing._pair(2).alias("f")).first()["f"]
        left, done = fold(items, 2, lambda _, a, b: draws[a, b])
        assert {(r["id"], r["n"]): r["p"] for r in got["done"]} == done, case
        assert (got["left"] is None) == (left is None)
        if left:
            assert (got["left"]["id"], got["left"]["n"]) == left[0] and abs(got["left"]["p"] - left[2]) < 1e-9


def test_many_copies_and_odd_columns(spark):
    """20,000 rows alike: each is drawn for itself, and columns with any name come back."""
    base = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit("v").alias("a.b"), F.lit(1).alias("n"))
    other = spark.createDataFrame([(i, "w " * 50, f"t{i % 3}", "u", 2) for i in range(60)], "doc_id long, text string, source string, `a.b` string, n int")
    docs_ = base.union(other)
    out = mixing.mix(docs_)
    assert out.columns == docs_.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    by_row = mixing.mixed(docs_)
    share = by_row.where("doc_id = 5").select(F.first("target") / F.first("source_size")).first()[0]
    assert abs(counts[5] - share * 20_000) <= 20
    assert out.where("doc_id = 5").select("`a.b`").distinct().collect()[0][0] == "v"
