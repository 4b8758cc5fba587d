import random
import zlib
from collections import defaultdict

import pytest

from siftstone.llm import sharding

DOCS = "doc_id long, text string, source string, shard string, size string, range int"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, "x", "y", 0) for k, t, s in rows], DOCS)


def corpus(seed=0, n=600):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "é"]) * rng.choice([1, 20, 300]), rng.choice(["hot", "hot", "b", "c", None])) for i in range(n)]
    return [*rows, (None, "x", "b"), (n, None, "b"), (n + 1, "", None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]


def check(rows, got, shards=8):
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    total, largest = sum(s for s, _ in want), max(s for s, _ in want)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= largest


@pytest.mark.parametrize(("ranges", "samples", "slack"), [(1024, 32, 2.0), (300, 3, 0.2), (400, 32, 0.1)])
def test_shards_are_of_near_equal_bytes(spark, ranges, samples, slack):
    rows = corpus()
    got = sharding.sharded(docs(spark, rows), ranges=ranges, samples=samples, slack=slack).collect()
    check(rows, got)
    again = sharding.sharded(docs(spark, rows[::-1]).repartition(5), ranges=ranges, samples=samples, slack=slack).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def plain(rows, ranges, samples):
    """(doc_id, shard, slot) by plain loops: a sample by share of bytes, its quantiles as splitters, shards as runs of ranges."""
    key = lambda r: (r[2] is not None, r[2] or "", r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    order = sorted(map(key, rows))
    total = sum(k[-1] for k in order)
    sample = [i for i, k in enumerate(order) if (k[4] * sharding.BY_CRC + k[3] % 2**31 * sharding.BY_ID) % 2**32 / 2**32 < k[5] * (ranges * samples / total)]
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)})
    number = [sum(c <= i for c in cuts) for i in range(len(order))]
    held = defaultdict(int)
    for r, k in zip(number, order, strict=True):
        held[r] += k[5]
    shard, before = {}, 0
    for r in sorted(held):
        shard[r] = min(7, (2 * before + held[r]) * 8 // (2 * total))
        before += held[r]
    out, slots = [], defaultdict(int)
    for r, k in zip(number, order, strict=True):
        out.append((k[3] if k[2] else None, shard[r], slots[shard[r]]))
        slots[shard[r]] += 1
    return out


@pytest.mark.parametrize(("ranges", "samples"), [(64, 4), (16, 2), (8, 1), (200, 1)])
def test_shards_come_from_the_splitters(spark, ranges, samples):
    rows = corpus(seed=3)
    got = sharding.sharded(docs(spark, rows), ranges=ranges, samples=samples, slack=1e9).collect()
    assert sorted(map(repr, plain(rows, ranges, samples))) == sorted(repr((r["doc_id"], r["shard"], r["slot"])) for r in got)


def test_overfull_ranges_are_subdivided_by_key(spark):
    """Two ranges of one sample each are far off; their parts aren't, and the order stays the key's."""
    rows = corpus(seed=4)
    rows += [(10_000 + i, None, "hot") for i in range(2000)]
    df = sharding.sized(docs(spark, rows))
    cut = sharding.ranged(df, sharding.splitters(df, sum(len((t or "").encode()) + 1 for _, t, _ in rows), 4, 1))
    parts = sharding.subdivided(cut, 100_000, len(rows), 64, 16, 2.0).collect()
    by = defaultdict(list)
    for r in parts:
        by[r["range"], r["sub"]].append(r["key"])
    assert max(map(len, by.values())) < 8 * len(rows) / 64 and len(by) > 32
    runs = [(min(by[k]), max(by[k])) for k in sorted(by)]
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_shards_follow_the_key(spark):
    """Where each record is a range of its own, the result is that of one running sum over all records in the order of the key."""
    rows = [(i, t, s) for i, (_, t, s) in enumerate(corpus()[:600])]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(docs(spark, rows), ranges=1 << 14, samples=1 << 10).collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or "", r[0]))
    size = lambda r: len(r[1].encode()) + 1
    total, before, slots, want = sum(map(size, rows)), 0, defaultdict(int), {}
    for r in order:
        shard = min(7, (2 * before + size(r)) * 8 // (2 * total))
        want[r[0]] = (shard, slots[shard])
        slots[shard] += 1
        before += size(r)
    assert got == want


def test_one_hot_key_is_subdivided(spark):
    rows = [(7, "x" * (i % 50), "s") for i in range(500)]
    check(rows, sharding.sharded(docs(spark, rows), ranges=512).collect())


def test_few_or_no_records(spark):
    assert sharding.sharded(docs(spark, [])).count() == 0
    got = sharding.sharded(docs(spark, [(1, "a" * 1000, "s"), (2, None, None)])).collect()
    assert sorted(r["slot"] for r in got) == [0, 0]
