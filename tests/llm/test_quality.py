import random
import zlib

import numpy as np

from siftstone.llm import quality

DOCS = "doc_id long, text string, score string, row string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    words = ["river", "stone", "winter", "garden", "letter", "silver", "morning", "walked", "under", "quiet"]
    rows = []
    for i in range(n):
        good = i % 3 != 0
        body = " ".join(rng.choice(words) for _ in range(rng.randint(40, 120))) + "."
        rows.append((i, body if good else "".join(w + rng.choice(["***", "$$$ ", "!! "]) for w in body.upper().split()), int(good)))
    return rows


def tables(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t, _ in rows] + [(*e, "s", "r") for e in extra], DOCS)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], LABELS)


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    got = quality.classified(*tables(spark, rows)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_only_trained_labels_matter(spark):
    rows = corpus(120)
    flipped = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, t, q in rows]
    scores = lambda rs: {r["doc_id"]: r["score"] for r in quality.classified(*tables(spark, rs)).collect()}
    assert scores(rows) == scores(flipped) == scores(rows[::-1])


def test_odd_documents_get_scores(spark):
    rows = corpus(120)
    extra = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "x"), (1003, " é" * 200_000), (0, rows[0][1]), (1004, rows[0][1])]
    docs, labels = tables(spark, rows, extra)
    labels = labels.union(spark.createDataFrame([(0, 0, 0), (0, 1, 0), (None, 1, 0), (5000, 1, 0), (4, None, 1)], LABELS))
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1004)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (1000, 1001)}) == 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_without_labels_or_documents(spark):
    docs, labels = tables(spark, corpus(10))
    assert {r["score"] for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}
    one_kind = quality.classified(docs, labels.where("quality = 1"))
    assert min(r["score"] for r in one_kind.collect()) > 0.99
    assert quality.classified(docs.limit(0), labels).count() == 0


def test_flat_trees_are_walked_as_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    forest = quality.train(x, ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float), trees=10, depth=3)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x), [walk(r) for r in x])
    deep = quality.train(x, ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float))
    assert ((deep.scores(x) > 0.5) == ((x[:, 0] > 0) ^ (x[:, 3] > 0.5))).mean() > 0.95


def test_the_sample_is_bounded(spark):
    docs, labels = tables(spark, corpus(200))
    assert quality.sampled_labels(docs, labels, 50).count() == 50


def plain_train(x, y, trees, depth, bins, rate, least, l2):
    """Scores of x by boosting grown node by node from the rows, without histograms or arrays of nodes."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                total[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)  # noqa: B023
                return
            best = (1e-9, None)
            for f in range(x.shape[1]):
                for t in edges[f]:
                    low = rows[x[rows, f] <= t]
                    high = rows[x[rows, f] > t]
                    if min(h[low].sum(), h[high].sum()) < least / 4:  # noqa: B023
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: B023, E731
                    gain = part(low) + part(high) - part(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (low, high))
            low, high = best[1] if best[1] else (rows, rows[:0])
            grow(low, level + 1)
            if len(high):
                grow(high, level + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-total))


def test_training_against_plain_boosting():
    rng = np.random.default_rng(3)
    for _ in range(4):
        x = rng.normal(size=(160, 4)).round(2)
        y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(160) < 0.1)).astype(float)
        forest = quality.train(x, y, trees=6, depth=3, bins=8, rate=0.3, least=4.0, l2=1.0)
        assert np.allclose(forest.scores(x), plain_train(x, y, 6, 3, 8, 0.3, 4.0, 1.0), atol=1e-9)


def test_statistics_against_plain_counts():
    for text in ("One two two.\nONE 2 !!\n\nOne two two.", "é#x y", "a", " \n"):
        body = text.encode()
        got = dict(zip(quality.STATISTICS, quality.statistics(body), strict=True))
        words = body.split()
        assert np.isclose(got["log_words"], np.log1p(len(words))) and np.isclose(got["log_bytes"], np.log1p(len(body)))
        assert np.isclose(got["digit"], sum(c in b"0123456789" for c in body) / len(body)) and np.isclose(got["wide"], sum(c > 127 for c in body) / len(body))
        if words:
            assert np.isclose(got["word_length"], np.mean([len(w) for w in words])) and np.isclose(got["distinct_words"], len(set(words)) / len(words))
            lines = [x for x in body.split(b"\n") if x.strip()]
            assert np.isclose(got["lines_repeated"], 1 - len(set(lines)) / len(lines)) and got["longest_word"] == max(map(len, words))
