import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftstone.llm import lexical, wavelet
from siftstone.llm.words import Vocabulary, counts, words

DOCS = "doc_id long, text string, item string, score int, part int"
ITEMS = "item_id long, text string, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (doc, c) in enumerate(found):
            s = 0
            for t in terms(text):
                if c[t]:
                    m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, row))
        out += [(item, r + 1, None if unnamed else doc, -s) for r, (s, unnamed, doc, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    rows = lexical.ranked(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS), **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdeÉñ ") + str(i) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    return docs, [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30])))) for i in range(12)]


@pytest.mark.parametrize(("tokens", "item_terms"), [(50, 10), (2_000, 1_000), (10**6, 10**6)])
def test_equals_scoring_every_document(spark, tokens, item_terms):
    docs, items = corpus(tokens, 150)
    docs += [(i + 1000, t) for i, t in docs[:80]]
    assert searched(spark, docs, items, tokens=tokens, item_terms=item_terms) == brute(docs, items)


def test_defined_cases(spark):
    long = "Alpha beta " * 100_000
    docs = [(5, "alpha"), (4, "ALPHA"), (None, "alpha"), (3, None), (2, ""), (1, "  .,;"), (6, "É é x"), (7, long), (8, "beta-beta"), (8, "beta-beta"), (9, "\x00\x7fa_b\x0b")]
    items = [(1, "Alpha alpha gamma"), (1, "beta"), (None, "É"), (2, None), (3, ""), (4, "?"), (5, "nowhere"), (6, "a b")]
    assert searched(spark, docs, items) == brute(docs, items)
    assert [r[2] for r in searched(spark, docs, [(1, "alpha")])] == [7, 4, 5, None]


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_the_tree_finds_the_best_without_opening_all_nodes(monkeypatch):
    rng = np.random.default_rng(3)
    n, lists = 4096, []
    for share in (0.5, 0.3, 0.02, 0.01):
        docs = np.flatnonzero(rng.random(n) < share)
        impacts = rng.integers(1, 1000, len(docs))
        order = np.lexsort((docs, -impacts))
        lists.append((docs[order], impacts[order]))
    docs, impacts = np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists])
    edges = np.cumsum([0, *(len(x[0]) for x in lists)])
    tree = wavelet.Tree.load(wavelet.level_bits(docs, 12), impacts, 12)
    weights = np.array([1, 2, 30, 40])
    scores = np.zeros(n, np.int64)
    for (d, i), w in zip(lists, weights, strict=True):
        scores[d] += w * i
    opened, children = [], wavelet._children
    monkeypatch.setattr(wavelet, "_children", lambda tree, weights, of: opened.append(len(of.bound)) or children(tree, weights, of))
    found, got = wavelet.search(tree, edges[:-1], edges[1:], weights, 20)
    want = np.lexsort((np.arange(n), -scores))[:20]
    assert found.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
    assert sum(opened) < n / 2
    assert len(wavelet.search(tree, edges[:-1], edges[1:], weights, 20, int(got[4]))[0]) >= 5
    assert len(wavelet.search(tree, edges[:-1], edges[1:], weights, 20, int(got[0]) + 1)[0]) == 0


def test_words_and_their_counts():
    import pyarrow as pa

    sample = [None, "", "a", " a", "a ", "A-b_c", "ñÉ z9", " ", "x" * 1000, "é é"]
    assert [[w.decode() for w in words(t.encode() if t is not None else None)] for t in sample] == [terms(t) for t in sample]
    column = pa.array([t.encode() if t is not None else None for t in sample], pa.binary())
    assert counts(column).tolist() == [len(terms(t)) for t in sample]
    assert counts(column[3:7]).tolist() == [len(terms(t)) for t in sample[3:7]]
    numbers = Vocabulary()
    assert numbers.numbers([b"a", b"b", b"a"]).tolist() == [0, 1, 0] and list(numbers) == [b"a", b"b"]
