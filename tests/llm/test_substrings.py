import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import bwt, substrings, windows

DOCS = "doc_id long, text string, h string, id string, ranges int"


def sorted_suffixes(docs):
    """The transform and common prefixes of a collection, by sorting all suffixes."""
    suffixes = sorted((([*(x + 1 for x in d[i:]), j - len(docs)]), j, i) for j, d in enumerate(docs) for i in range(len(d) + 1))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcp = [0] + [shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    return [docs[j][i - 1] + 1 if i else 0 for _, j, i in suffixes], lcp


@pytest.mark.parametrize("seed", range(60))
def test_the_transform_is_that_of_sorted_suffixes(seed):
    rng = random.Random(seed)
    docs = [bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 8))]
    got = bwt.build(docs, 200)
    assert (got[0].tolist(), got[1].tolist()) == sorted_suffixes(docs)


def counted(docs, weights, width):
    n = Counter()
    for d, w in zip(docs, weights, strict=True):
        for i in range(len(d) - width + 1):
            n[d[i : i + width]] += w
    return [[n[d[i : i + width]] > 1 for i in range(len(d) - width + 1)] for d in docs]


@pytest.mark.parametrize("seed", range(60))
def test_recurring_strings(seed):
    rng = random.Random(seed)
    width = rng.choice([4, 7, 16])
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 20))) for _ in range(5)]
    docs = list({b"".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(20)})
    docs = [d for d in docs if len(d) >= width]
    if not docs:
        return
    weights = np.array([rng.choice([1, 1, 2]) for _ in docs])
    assert [x.tolist() for x in substrings.recurring(docs, weights, width)] == counted(docs, weights, width)
    assert [x.tolist() for x in bwt.repeated_starts(docs, weights, width)] == counted(docs, weights, width)


def template(seed, n, width=200):
    """Texts with a short passage in many surroundings, some of which share more."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    passage, longer = word(60), word(150)
    out = [word(rng.randint(120, 260)) + passage + word(rng.randint(120, 260)) for _ in range(n)]
    return out + [word(100) + longer + passage + word(rng.randint(0, 200)) for _ in range(n // 10)]


@pytest.mark.parametrize("max_class", [8192, 40, 3])
def test_large_classes_are_split(spark, max_class):
    """A passage in hundreds of surroundings: whole or string by string, the result is the same."""
    rows = list(enumerate(template(5, 300)))
    got = substrings.removal_digests(docs(spark, rows), hot=50, max_class=max_class).collect()
    want = [(k, len(t), r, s, hashlib.sha256(kept).hexdigest()) for (k, t), (r, s, kept) in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert sum(r for _, _, r, _, _ in want) > 0 and sorted(map(tuple, got)) == sorted(want)


def test_pieces_hold_each_string_once_and_equal_ones_share_a_class():
    rng = random.Random(3)
    common = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 150))) + common + b"x" * rng.randint(0, 80) for _ in range(30)] + [b"", b"a" * 400]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    width, seen, classes = 40, Counter(), {}
    for t, key, start, n in zip(*windows.pieces(data, bounds, width, 16), strict=True):
        assert 1 <= n <= width
        for i in range(start, start + n):
            seen[int(t), int(i - bounds[t])] += 1
            classes.setdefault(data[i : i + width].tobytes(), set()).add(int(key))
    assert seen == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - width + 1))
    assert all(len(k) == 1 for k in classes.values())


def brute(texts, width):
    """(n_removed, n_spans, kept) of each text."""
    bodies = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append((sum(gone), sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghij klmé\n") for _ in range(n))
    passages = [noise(rng.randint(190, 500)) for _ in range(4)]
    texts = [noise(rng.randint(0, 300)) + rng.choice([*passages, ""]) + noise(rng.randint(0, 100)) + rng.choice([*passages, ""]) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1][:-3], None, "", "short", "ab" * 300, "z" * 900, "é" * 150, "y" * 150 + "w" * 50, passages[0][:199]]
    return [(i * 3 % 70, t) for i, t in enumerate(texts)]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "h", "i", 1) for k, t in rows], DOCS)


@pytest.mark.parametrize(("hot", "max_class"), [(20_000, 30_000), (3, 30_000), (3, 2)])
def test_removal_against_brute_force(spark, hot, max_class):
    """All ways that classes can go: by members, by kinds, and string by string."""
    rows = corpus()
    got = substrings.removal_digests(docs(spark, rows), hot=hot, max_class=max_class).collect()
    want = [(k, len((t or "").encode()), r, s, hashlib.sha256(kept).hexdigest()) for (k, t), (r, s, kept) in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_very_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LONGEST", 500)
    monkeypatch.setattr(substrings, "STRETCH", 900)
    texts = [t or "" for _, t in corpus(2)] + ["".join(random.Random(i).choice("abc\n") for i in range(5000))] * 2
    found = Counter()
    for owner, offset, bounds, data in substrings._stretches([t.encode() for t in texts], 200):
        for p, _, start, n in zip(*windows.pieces(data, bounds, 200, 32), strict=True):
            for i in range(n):
                found[int(owner[p]), int(start - bounds[p] + offset[p] + i)] += 1
    assert found == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x.encode()) - 199))


def test_texts_are_cleaned(spark):
    rows = corpus(4)
    kept = substrings.remove_recurring(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    want = [(k, None if t is None else b.decode("utf-8", "ignore")) for (k, t), (_, _, b) in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["h"], r["id"], r["ranges"]) for r in kept.collect()} == {("h", "i", 1)}
    assert substrings.remove_recurring(docs(spark, [])).count() == 0
    assert substrings.removal_digests(docs(spark, [])).count() == 0


def test_blocks_hold_whole_classes(monkeypatch):
    import pyarrow as pa

    rng = random.Random(0)
    keys = sorted(rng.choice(range(40)) for _ in range(600)) + [99] * 50
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + n], pa.int64())], ["key"]) for i, n in zip(range(0, 650, 50), [50] * 13, strict=True)]
    for size in (1, 100, 400, 10_000):
        monkeypatch.setattr(substrings, "BLOCK", size)
        blocks = [b.column(0).to_pylist() for b in substrings._blocks(iter(batches))]
        assert [k for b in blocks for k in b] == keys
        assert all(a[-1] != b[0] for a, b in zip(blocks, blocks[1:], strict=False))


@pytest.mark.parametrize("more", [[], [5, 5, 9]])
def test_a_first_batch_above_a_block_may_be_of_one_class(monkeypatch, more):
    rng = random.Random(6)
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    texts = [rng.randbytes(150) for _ in range(20)]
    keys = [5] * 20 + more
    texts += [texts[0]] * len(more)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(range(a, b), pa.int64()), pa.array([1] * (b - a), pa.int64()), pa.array(texts[a:b], pa.binary())], ["key", "d", "weight", "piece"])
    assert batch(0, 20).nbytes > substrings.BLOCK
    batches = [batch(0, 20), *([batch(20, len(keys))] if more else [])]
    blocks = [b.column(0).to_pylist() for b in substrings._blocks(iter(batches))]
    assert [x for b in blocks for x in b] == keys and len(set(map(max, blocks))) == len(blocks)
    found = [r for b in substrings.decide_kinds(100)(iter(batches)) for r in b.to_pylist()]
    assert {r["d"] for r in found} == ({0, 20, 21} if more else set())
