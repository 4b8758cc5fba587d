import random
import time

import numpy as np
import pytest

from siftstone.functions import automaton
from siftstone.functions.automaton import Automaton
from siftstone.operators import select


def found(needles, texts, key=24):
    text, needle = Automaton.of(needles, key).found(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    return list(zip(text.tolist(), needle.tolist(), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_equals_looking_for_each_needle(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(200):
        letters = rng.choice(["ab", "abc", "abcdefgh\x00\xff"])
        word = lambda n, more="": "".join(rng.choices(letters + more, k=n)).encode("latin-1")  # noqa: B023, E731
        needles = [word(rng.randint(1, rng.choice([2, 6, 30]))) for _ in range(rng.randint(0, 30))]
        texts = [word(rng.choice([0, 1, 5, 60]), "z") for _ in range(rng.randint(0, 20))]
        monkeypatch.setattr(automaton, "SEGMENT", rng.choice([1, 3, 16, 4096]))
        monkeypatch.setattr(automaton, "GATHERED", rng.choice([1, 10**6]))
        got = found(needles, texts, rng.choice([1, 2, 5, 24]))
        assert sorted(got) == [(i, j) for i, x in enumerate(texts) for j, y in enumerate(needles) if y in x]


def test_long_needles_and_texts():
    text = b"ab" * 500_000 + b"c"
    needles = [b"ab" * 300_000 + b"c", b"ab" * 600_000, b"bc", b"abab" * 10, b"cb"]
    assert found(needles, [text, b"", text[:10]]) == [(0, 0), (0, 2), (0, 3)]
    assert found([], [b"a"]) == [] and found([b"a"], []) == []


def test_time_is_that_of_the_texts_not_of_the_needles():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=400)).encode() for _ in range(400)]
    data, offsets = b"".join(texts), np.cumsum([0, *map(len, texts)])
    took = {}
    for n in (100, 10_000):
        a = Automaton.of([" ".join(rng.choices(words, k=4)).encode() for _ in range(n)])
        began = time.process_time()
        a.found(data, offsets)
        took[n] = time.process_time() - began
    assert took[10_000] < 5 * took[100] + 0.5  # a hundred times the needles


def test_rows_and_parts(spark):
    texts = spark.createDataFrame([(1, "one two", "x"), (2, None, "y"), (3, "", "z"), (4, "É two", None), (4, "É two", None)], "id long, text string, other string")
    needles = spark.createDataFrame([("two", 1), ("two", 1), ("É", 2), ("", 3), (None, 4), ("none", 5), ("e t", 6)], "needle string, n int")
    want = sorted([(1, "x", "two", 1)] * 2 + [(1, "x", "e t", 6)] + [(4, None, "two", 1)] * 4 + [(4, None, "É", 2)] * 2, key=str)
    for options in ({}, {"limit": 1}, {"limit": 3, "most": 4}, {"most": 1}):
        rows = select.contained(texts, needles, **options)
        assert rows.columns == ["id", "other", "needle", "n"]
        assert sorted(map(tuple, rows.collect()), key=str) == want
    assert select.contained(texts, needles.limit(0)).count() == 0 and select.contained(texts.limit(0), needles).count() == 0
    sizes = [[(r["needle"], r["n"]) for r in part] for part in select.gathered_parts(needles.where("needle <> ''"), "needle", 2, 100)]
    assert max(map(len, sizes)) <= 2 and sorted(x for s in sizes for x in s) == sorted([("two", 1), ("two", 1), ("É", 2), ("none", 5), ("e t", 6)])
