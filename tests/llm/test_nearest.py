import math

import numpy as np
import pytest

from siftstone.llm import nearest

VECTORS = "vec_id long, embedding array<float>, label int, row string, block int"


def found(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS.replace("float", kind))
    out = nearest.nearest(df, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    by = {}
    for r in out.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in by.items()}


def brute(rows, k, every):
    def product(a, b):
        return math.fsum(x * y for x, y in zip(a, b, strict=False))

    whole = [(n, i, v) for n, (i, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for n, i, v in whole:
        if i is not None and i % every == 0:
            best = sorted((-product(v, w), j is None, j or 0, m) for m, j, w in whole if m != n)[:k]
            out[i] = [(r + 1, None if unnamed else j, -s) for r, (s, unnamed, j, _) in enumerate(best)]
    return out


def singles(x):
    return np.asarray(x, "f4").astype(float).tolist()


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({x[1] for x in got[q]} & {x[1] for x in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("norms", [False, True])
def test_recall_against_all_products(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[300:900] = x[0] + 0.05 * rng.normal(size=(600, 24))  # a crowd
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.2, 5, size=(1500, 1))
    rows = [(i, singles(v)) for i, v in enumerate(x)]
    got, want = found(spark, rows, k=10, every=15, block=100, leaf=16, group=30), brute(rows, 10, 15)
    assert recall(got, want) >= 0.95
    vectors = dict(rows)
    for q, hits in got.items():
        assert all(s == math.fsum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)) for _, i, s in hits)
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)


def test_the_search_stops_early_in_clusters():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 32))
    x = (centers[:, None] + 0.1 * rng.normal(size=(40, 50, 32))).reshape(-1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = nearest.Space(1.0, 32)
    p = space.of_points(x)
    order, edges = nearest.leaves_of(p, 32)
    x, p = x[order], p[order]
    boxes = np.stack([np.stack([p[a:b].min(axis=0), p[a:b].max(axis=0)]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    own = np.arange(0, 2000, 20)
    scores = nearest.verified(x[own], space.of_queries(x[own]), own, np.full(100, -np.inf), x, p, edges, boxes, 10, nearest.bound(0.98, 12))
    true = x[own] @ x.T
    true[np.arange(100), own] = -np.inf
    want, got = np.argsort(-true, axis=1)[:, :10], np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(want, got, strict=True)]) >= 0.95
    assert (scores > -np.inf).mean() < 0.25


def test_noise_is_multiplied_as_matrices(monkeypatch):
    """Where nearly all pairs pass, vectors are not copied out pair by pair, and the same pairs are verified."""
    gathered = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, a, b: gathered.append(len(a)) or einsum(spec, a, b))
    x = np.random.default_rng(5).normal(size=(512, 64))
    x /= np.linalg.norm(x, axis=1).max()
    space = nearest.Space(1.0, 64)
    p = space.of_points(x)
    order, edges = nearest.leaves_of(p, 32)
    x, p = x[order], p[order]
    boxes = np.stack([np.stack([p[a:b].min(axis=0), p[a:b].max(axis=0)]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    own = np.arange(0, 512, 4)
    q = nearest.unit(x[own])
    scores = nearest.verified(q, space.of_queries(x[own]), own, np.full(128, -np.inf), x, p, edges, boxes, 10, nearest.bound(0.98, 12))
    seen = scores > -np.inf
    assert seen.mean() > 0.5 and sum(gathered) < 0.05 * seen.sum()
    assert not seen[np.arange(128), own].any()
    assert np.allclose(scores[seen], (q @ x.T)[seen], atol=1e-12)


def test_defined_cases(spark):
    one, two = [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]
    rows = [(0, one), (20, two), (1, None), (2, []), (3, [0.0] * 3), (4, [1.0, None, 0.0]), (5, [math.nan, 1.0, 0.0]), (6, [math.inf, 0.0, 0.0]), (None, one), (7, one), (7, one), (8, [2.0]), (9, [0.0, 0.0, 0.0, 4.0]), (40, [-1.0, 0.0, 0.0]), (60, None), (10, [-1e-3, 1.0, 0.0])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(spark, rows, k=20) == brute(rows, 20, 20)
    assert found(spark, rows, k=3) == brute(rows, 3, 20)


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(i, [2.0, 1.0]) for i in range(300, 600)] + [(601, [3.0, 3.0])]
    for k in (1, 5):
        assert found(spark, rows, kind="double", k=k, block=20, leaf=4, group=3) == brute(rows, k, 20)


def test_empty_and_lone(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, None)]) == {}
    assert found(spark, [(1, [1.0])]) == {}
    assert found(spark, [(20, [1.0, 2.0])]) == {}


def test_chi_square_quantiles():
    assert nearest.bound(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert nearest.bound(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert nearest.bound(0.99, 12) == pytest.approx(26.217, abs=1e-3)
