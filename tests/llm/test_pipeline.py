import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftstone.llm import mixing, quality, queries
from siftstone.llm.common import shared_folder
from tests.llm.test_jaccard import brute as near_groups
from tests.llm.test_quality import corpus
from tests.llm.test_substrings import brute as removed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and junk documents, copies, near copies, and a passage that several share."""
    rng = random.Random(5)
    out = tmp_path_factory.mktemp("sf")
    words = ["river", "stone", "winter", "garden", "letter", "silver", "morning", "walked", "under", "quiet", "harbour", "lantern"]
    prose = lambda n: " ".join("".join(rng.sample(words, 2)) for _ in range(n)) + "."
    passage = prose(40)
    rows = [(i, t) for i, t, _ in corpus(150)]
    rows += [(1000 + i, prose(60) + " " + passage + " " + prose(60)) for i in range(6)]
    base = prose(200)
    rows += [(2000, base), (2001, base), (2002, base + " end")]
    rows += [(3000, None), (3001, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i != 3001 else None, len(t or "")) for i, t in rows], DOCS)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in corpus(150)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), passage


def test_stages_one_by_one(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        held[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    kept = {r["doc_id"]: r["text"] for r in held["quality_classifier"]}
    truth = {i: q for i, _, q in corpus(150)}
    assert sum(truth[i] for i in truth if i in kept) / max(1, sum(i in kept for i in truth)) > 0.95
    assert {1000, 1001, 2000, 2001, 2002} <= kept.keys()
    # the classifier's decisions are its query's
    scores = quality.classified(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert Counter(kept.keys()) == Counter(r["doc_id"] for r in scores.where("predicted = 1").collect())
    single = {r["doc_id"] for r in held["near_dedup"]}
    ids = sorted(kept)
    assert single == {ids[i] for i in near_groups([kept[i] for i in ids])}
    assert len(single & {2000, 2001, 2002}) == 1 and single <= kept.keys()
    cleaned = {r["doc_id"]: (r["text"], r["n_chars"]) for r in held["suffix_array_dedup"]}
    assert cleaned.keys() == single
    order = sorted(single)
    want = {i: b.decode("utf-8", "ignore") for i, (_, _, b) in zip(order, removed([kept[i] for i in order], 200), strict=True)}
    assert {i: t or "" for i, (t, _) in cleaned.items()} == want
    assert all(passage not in (t or "") and len(t or "") == n for t, n in cleaned.values())
    mixed = Counter(r["doc_id"] for r in held["source_mixing"])
    assert mixed.keys() <= cleaned.keys() and max(mixed.values()) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(n * words(cleaned[i][0]) for i, n in mixed.items()) == pytest.approx(sum(words(t) for t, _ in cleaned.values()), rel=0.2)
    packed = held["length_packing"]
    # what was cleaned comes out whole
    assert all((r["text"], r["n_chars"]) == cleaned[r["doc_id"]] for r in packed)
    assert {r["doc_id"]: (r["lang"], r["source"]) for r in packed}.items() <= {r["doc_id"]: (r["lang"], r["source"]) for r in held["suffix_array_dedup"]}.items()
    assert Counter(r["doc_id"] for r in packed) == mixed
    assert all(r["n_tokens"] == words(cleaned[r["doc_id"]][0]) + 1 for r in packed)


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted(map(repr, rows)) == sorted(map(repr, docs.collect()))


def test_run_leaves_one_copy_behind(spark, folder):
    path, _ = folder
    shared = Path(shared_folder(spark).removeprefix("file:"))
    whole = lambda: {p.name for p in shared.iterdir() if any(p.glob("*.parquet"))}
    before = whole()
    docs = corpus_pipeline.run(spark, path)
    left = whole() - before
    assert len(left) == 1 and next(iter(left)).startswith("rows-")
    assert docs.count() > 0


def test_stages_take_empty_and_wider_tables(spark, folder):
    path, _ = folder
    wide = spark.read.parquet(f"{path}/documents.parquet").withColumn("row", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("a.b", F.lit("y")).withColumn("id", F.lit(2)).withColumn("key", F.lit(3)).withColumn("text is null", F.lit("z")).withColumn("batch", F.lit(5)).withColumn("given", F.lit(6))
    for docs in (wide.limit(0), wide):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, stage(spark, docs, path)
            assert docs.columns[: len(before)] == before
        rows = docs.select("row", "copies", "`a.b`", "id", "key", "`text is null`", "batch", "given").distinct().collect()
        assert [tuple(r) for r in rows] in ([], [("x", 1, "y", 2, 3, "z", 5, 6)])


def test_mix_target_is_a_fair_share(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "source string, size long")
    assert sorted(r["target"] for r in mixing.source_targets(rows).collect()) == [50.0, 100.0, 150.0]


def test_queries_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert set(queries.oracle_sql()) <= set(names)
