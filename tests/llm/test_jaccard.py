import random

from siftstone.llm import jaccard, simhash

DOCS = "doc_id long, text string"


def brute(texts):
    """For each text the least number of a text that a chain of pairs of similarity 0.8 leads to."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return least


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([6, 60, 300]))]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.03):  # similarities on both sides of 0.8
            base = [word() if rng.random() < share else w for w in base] if rng.random() < 0.5 else [*base[: len(base) - 1 - int(len(base) * share * 5)], word()]
            texts.append(" ".join(base))
    return [*texts, None, "", " \n", "One two", "one TWO", "x " * 1000]


def test_stage_keeps_one_of_each_group_at_similarity_0_8(spark):
    texts = corpus()
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert kept == set(brute(texts))


def template():
    """Texts that share a half with one another, some of which are near copies; the shared half makes popular bands."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(300)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(110)]
        texts.append(" ".join(common + own))
        if rng.random() < 0.4:
            texts.append(" ".join([*common, *own[:-6], *(word() for _ in range(6))]))
    return texts


def test_crowded_bands_are_parted(spark):
    texts = template()
    want = brute(texts)
    assert 60 <= len(set(want)) < len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    sizes = []
    real = jaccard._members
    jaccard._members = lambda keyed: sizes.append(m := real(keyed)) or m
    try:
        for hot in (10**6, 12):
            sizes.clear()
            got = {r["key"]: r["component_id"] for r in jaccard.near_copies(docs, hot=hot).collect()}
            assert [got[i] for i in range(len(texts))] == want
            assert (len(sizes) > 1) == (hot == 12)
    finally:
        jaccard._members = real


def test_groups_that_no_band_parts_are_searched_in_pieces(spark, monkeypatch):
    texts = template()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    held = []
    monkeypatch.setattr(jaccard, "LEVELS", 0)
    monkeypatch.setattr(jaccard, "_in_pieces", lambda *x, f=jaccard._in_pieces: held.append(f(*x)) or held[-1])
    got = {r["key"]: r["component_id"] for r in jaccard.near_copies(docs, hot=12).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert held
    for n in (13, 50):
        alike = " ".join(f"w{i}" for i in range(200))
        same = [jaccard.shingles((alike + f" e{i}").encode()) for i in range(n)]
        rows = spark.createDataFrame([(7, f"{i:02}".encode(), n) for i in range(n)], "band long, name binary, n long")
        links = jaccard._in_pieces(rows, spark.createDataFrame([(f"{i:02}".encode(), x.tobytes()) for i, x in enumerate(same)], "name binary, shingles binary"), 12).collect()
        groups = {i: {i} for i in range(n)}
        for r in links:
            a, b = groups[int(r["a"])], groups[int(r["b"])]
            if a is not b:
                a |= b
                for i in b:
                    groups[i] = a
        assert len(groups[0]) == n


def test_search_goes_on_from_what_was_reached(spark):
    chain = [" ".join(f"w{i}" for i in range(k, k + 200)) for k in range(0, 200, 10)]
    assert {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(chain)), DOCS)).collect()} == {0}
    sets = [jaccard.shingles(t.encode()) for t in chain]
    assert len(jaccard.spanning(list(range(20)), sets)) == 19
