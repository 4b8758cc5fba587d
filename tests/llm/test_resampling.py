import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftstone.llm import resampling

DOCS = "doc_id long, text string, rank string, id int, bucket int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def brute(docs, target, percent=5, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    source, aimed = Counter(bucket(f) for _, t in docs for f in features(t)[1]), Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = source.total(), aimed.total()
    out = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((aimed[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(spark, docs, target, **options):
    rows = resampling.resampled(spark.createDataFrame([(i, t, "r", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcÉñ9Z", k=rng.randint(1, 9))) for _ in range(80)]
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(80)], k=rng.choice([0, 1, 2, 19, 20, 60, 300])))) for i in range(n)], [" ".join(rng.choices(vocabulary, k=30)) for _ in range(10)]


@pytest.mark.parametrize("size", [10, 1_000, 10**6])
def test_equals_counting_every_feature(spark, size):
    docs, target = corpus(200)
    assert drawn(spark, docs, target, size=size, percent=30) == brute(docs, target, percent=30)


def test_defined_cases(spark):
    long = "Very long text, with 9 words or So. " * 20_000
    docs = [(1, None), (2, ""), (None, "a b c " * 10), (3, "x"), (4, "x y"), (5, long), (6, "É" * 3000 + " e"), (6, "É" * 3000 + " e"), (7, "a b c " * 10), (8, "a b c " * 10), (9, "\x00_[]`{\x7f")]
    assert drawn(spark, docs, ["a b", None, ""], percent=60) == brute(docs, ["a b", None, ""], percent=60)
    assert drawn(spark, docs, [], percent=100) == brute(docs, [], percent=100)
    assert drawn(spark, [], ["a"]) == []


def test_equal_scores_go_by_id_and_repeated_rows_count(spark):
    docs = [(3, "a b c " * 10)] * 4 + [(2, "a b c " * 10)] * 2
    got = drawn(spark, docs, ["a"], percent=50)
    assert got == brute(docs, ["a"], percent=50) and sum(r[4] is not None for r in got) == 3


def test_checksums_of_joined_words():
    rng = random.Random(1)
    held = [bytes(rng.choices(range(97, 250), k=rng.choice([1, 2, 7, 40, 5000]))) for _ in range(50)]
    sums = resampling.Checksums(held)
    a, b, c = (np.array(rng.choices(range(50), k=300)) for _ in range(3))
    got = sums.followed(sums.followed(sums.word[a], b), c)
    assert got.tolist() == [zlib.crc32(b" ".join((held[x], held[y], held[z]))) for x, y, z in zip(a, b, c, strict=True)]


def test_large_vocabularies_are_ordered_word_by_word():
    rng = random.Random(2)
    found = [[str(rng.randrange(50)).encode() for _ in range(n)] for n in (0, 1, 2, 300)]
    block = resampling.Block(found, 3)
    packed = block.counts(97)
    block.order = np.lexsort(block.following[::-1])
    assert block.counts(97).tolist() == packed.tolist()
