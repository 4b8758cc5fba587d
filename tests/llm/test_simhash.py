import random
import re

import numpy as np
import xxhash

from siftstone.llm import components, simhash

DOCS = "doc_id long, text string, fp string, component_id int"


def brute(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def groups(keys, fps):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(keys))]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "f", 0) for k, t in texts], DOCS)


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(300)] for _ in range(6)]
    texts = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 40])):
            words[rng.randrange(300)] = "Changed"
        texts.append((i * 7 % 101, " ".join(words)))
    texts += [(200, None), (201, ""), (202, " \x1f\n"), (203, "One two"), (204, "ONE\vtwo"), (205, "É é"), (7, texts[0][1]), (206, "x " * 100_000)]
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    fps = brute([t for _, t in texts])
    want = sorted(zip([k for k, _ in texts], fps, groups([k for k, _ in texts], fps), strict=True))
    assert sorted((r["key"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want


def test_every_close_pair_meets(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for s in seeds]
    fps = sorted({*map(int, seeds), *near})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    labels = {r["node"]: r["component"] for r in components.components(simhash.links(df)).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda x: labels.get(signed(int(x)), signed(int(x)))
    assert all(of(s) == of(n) for s, n in zip(seeds, near, strict=True) if int(s) != n)


def test_a_dense_group_gives_few_links(spark):
    fps = [(1 << a) | (1 << b) for a in range(40) for b in range(a)]
    found = simhash.spanning_links(np.array(fps, dtype=np.uint64), 4)
    assert found.shape[1] == len(fps) - 1


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(500, 501), (501, 501), (1, 0)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 151)} | {501: 500}
    assert components.components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(0)
    a, b = (" ".join(rng.choice("abcdefgh") * 3 for _ in range(100)) for _ in range(2))
    rows = docs(spark, [(5, a), (3, a), (3, a), (9, b), (None, None), (11, ""), (12, b + " z")])
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())[:2] == [(False, 3), (False, 9)]
    assert sum(r["text"] in (None, "") for r in kept.collect()) == 1
    assert simhash.one_of_each(rows.limit(0)).count() == 0


def test_crowded_blocks_are_cut_and_lose_no_pair(spark):
    """Thousands of fingerprints share blocks without being alike; a few pairs among them are."""
    rng = np.random.default_rng(8)
    fixed = 0x5A5A5A5 << 36
    members = {fixed | int(x) for x in rng.integers(0, 1 << 36, 3000)}
    near = [(m, m ^ sum(1 << int(b) for b in rng.choice(36, rng.integers(1, 5), replace=False))) for m in list(members)[:40]]
    fps = sorted(members | {b for _, b in near})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4}
    for hot in (10**6, 1000, 40):
        labels = {r["node"]: r["component"] for r in components.components(simhash.links(df, hot=hot)).collect()}
        of = lambda x: labels.get(x, x)
        assert len(want) >= 40 and all(of(a) == of(b) for a, b in want)
        assert all((r["a"] ^ r["b"]) & (1 << 64) - 1 and ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in simhash.links(df, hot=hot).collect())


def test_parts_cover_the_free_bits():
    for mask in (0, 1, (1 << 63) | 0xFF00, (1 << 52) - 1):
        parts = simhash._parts(mask, 5)
        assert [p & mask for p in parts] == [mask] * 5
        free = [p & ~mask for p in parts]
        assert sum(free) == ~mask & (1 << 64) - 1 and max(x.bit_count() for x in free) - min(x.bit_count() for x in free) <= 1


def test_rows_alike_and_odd_columns(spark):
    """20,000 rows alike but for a column with an odd name: one stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text, i % 7, "r") for i in range(20_000)] + [(2, "other words entirely here now", 1, "r")], "doc_id long, text string, `a.b` int, `row` string")
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
