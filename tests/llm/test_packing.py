import itertools
import random

import pytest

from siftstone.llm import packing

DOCS = "doc_id long, text string, bucket string, n_tokens string"


def padding(hist, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist)


@pytest.mark.parametrize("seed", range(30))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    hist = [(n, rng.choice([1, 2, 50, 0])) for n in rng.sample(range(1, 60), rng.randint(1, 9))]
    real = [(n, c) for n, c in hist if c]
    k = rng.randint(1, 5)
    bounds = packing.optimal_bounds(hist, k)
    if not real:
        assert bounds == []
        return
    lengths = sorted(n for n, _ in real)
    best = min(padding(real, (*c, lengths[-1])) for i in range(k) for c in itertools.combinations(lengths[:-1], i))
    assert bounds == sorted(bounds) and len(bounds) <= k and padding(real, bounds) == best


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "b", "n") for i, t in rows], DOCS)


def test_batches_fit_and_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.choice([3, 4, 9, 30, 120]))) for i in range(400)] + [(500, None), (501, ""), (502, " \t\n"), (7, "a b c"), (7, "a b c"), (None, "x y"), (503, "w " * 5000)]
    got = packing.packed(docs(spark, rows), budget=256, buckets=4).collect()
    assert len(got) == len(rows)
    lengths = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_tokens"] and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        lengths.setdefault((r["bucket"], r["batch"]), []).append((r["slot"], r["bucket_tokens"]))
    for slots in lengths.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert len(slots) == 1 or sum(b for _, b in slots) <= 256
    for bucket in {b for b, _ in lengths}:
        numbers = sorted(n for b, n in lengths if b == bucket)
        assert numbers == list(range(len(numbers)))
        full = [len(lengths[bucket, n]) for n in numbers[:-1]]
        assert len(set(full)) <= 1  # all but the last are full
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["n_tokens"] for k in (500, 501, 502, None)] == [1, 1, 1, 3]
    assert by_id[503]["padding"] == 0 and by_id[503]["n_tokens"] == 5001
    again = packing.packed(docs(spark, rows[::-1]).repartition(3), budget=256, buckets=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_empty(spark):
    assert packing.packed(docs(spark, [])).count() == 0


def test_any_number_of_ranges_gives_the_same_places(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(500), " ".join("w" * rng.choice([1, 2, 3]))) for _ in range(900)] + [(7, "w w")] * 300
    want = {}
    for i, t in sorted(rows, key=lambda r: (r[0], len(r[1]))):
        want.setdefault(len(t.split()) + 1, []).append(i)
    for parts in ("1", "8", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = packing.packed(docs(spark, rows), budget=12, buckets=4).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        by = {}
        for r in got:
            by.setdefault(r["n_tokens"], []).append((r["batch"], r["slot"], r["doc_id"]))
        assert {n: [i for *_, i in sorted(x)] for n, x in by.items()} == want


def test_rows_go_along(spark):
    rows = [(1, "a b", "x", 5, "s"), (2, None, None, None, None), (1, "a b", "y", 6, "s"), (None, "q " * 50, "z", 7, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, slot int, `row` string")
    got = packing.packed_rows(df, budget=16, buckets=2)
    assert got.columns == ["doc_id", "text", "a.b", "slot", "row", "n_tokens", "bucket", "bucket_tokens", "batch", "slot_2", "padding"]
    assert sorted((repr(r["text"]), repr(r["a.b"]), r["n_tokens"]) for r in got.collect()) == sorted((repr(t), repr(x), len((t or "").split()) + 1) for _, t, x, _, _ in rows)
    assert packing.packed_rows(df.limit(0)).count() == 0


def test_given_names_stay(spark):
    given = spark.createDataFrame([(1, "a b", "x", 7, 9)], "doc_id long, text string, batch string, Bucket int, slot_2 int")
    rows = packing.packed_rows(given)
    assert rows.columns == ["doc_id", "text", "batch", "Bucket", "slot_2", "n_tokens", "bucket_2", "bucket_tokens", "batch_2", "slot", "padding"]
    assert tuple(rows.first()) == (1, "a b", "x", 7, 9, 3, 0, 3, 0, 0, 0)
