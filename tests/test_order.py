import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import chunk, order
from siftstone.sources import files


def brute(rows, total):
    """Rows (group, place, size) that are kept, by plain loops; alike ones together."""
    out, seen = [], {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in {r[0] for r in rows}:
        upto, last = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=key):
            if upto < total:
                last = key(r)
            upto += r[2]
        seen[g] = last
    out = [r for r in rows if seen[r[0]] is not None and key(r) <= seen[r[0]]]
    return sorted(out, key=str)


@pytest.mark.parametrize("total", [0, 1, 50, 400, 10**9])
def test_kept_rows_against_plain_loops(spark, total):
    rng = random.Random(total)
    rows = [(rng.choice(["a", "b", None]) if rng.random() < 0.5 else "hot", rng.choice([None, *range(120)]), rng.choice([0, 1, 7, 30, 500])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, p long, n long")
    got = order.within_total(df, ["g"], ["p"], "n", total, ranges=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, total)
    assert order.within_total(df.limit(0), ["g"], ["p"], "n", total).count() == 0


def test_a_hot_group_is_many_ranges(spark, monkeypatch):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.format_string("f%07d.py", F.col("id")).alias("path"), F.lit(3).alias("n"))
    held, real = [], order.ranged
    monkeypatch.setattr(order, "ranged", lambda *a: held.append(real(*a)) or held[-1])
    kept = order.within_total(rows, ["g"], ["path"], "n", 3 * 150_000 - 1, ranges=64)
    assert kept.count() == 150_000 and kept.agg(F.max("path")).first()[0] == "f0149999.py"
    sizes = [r["count"] for r in held[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 0.04 * n


def test_source_sample_is_the_first_files(spark):
    texts = [(f"d/{i:03}.py", "x" * (i % 5 * 10), 0) for i in range(90)] + [("d/a.txt", "no", 2)]
    table = spark.createDataFrame(texts, "path string, text string, size long")
    got = [(r["path"], r["text"]) for r in files.source_sample(table, [".py"], per_file=25, total=300).orderBy("path").collect()]
    want, upto = [], 0
    for path, text, _ in texts[:90]:
        if upto < 300:
            want.append((path, text[:25]))
        upto += min(25, len(text))
    assert got == want


def test_gathered_texts_keep_their_order(spark):
    rows = [("u", f"{i:02}.py", "line\n" * 5) for i in range(40)]
    text = chunk.gathered(spark.createDataFrame(rows, "unit string, path string, text string"), ["unit"], ["path"], total=100, per_part=12).first()["text"]
    assert [x for x in text.split("\n") if x.startswith("###")] == [f"### {i:02}.py" for i in range(9)]
