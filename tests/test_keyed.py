import random

from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.operators import union
from siftstone.streaming import keyed
from tests.tables import candidates

COLUMNS = ["key", "seq", *union.FIRST, "severity", "evidence", "status", "found_by", "n_rows"]


def shape(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def some(seed, n):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), n)
    return [{"seq": s, "symbol": rng.choice(["f", "g", "h", ""]), "file": rng.choice(["a.py", "b.py"]), "line": rng.choice([None, 1, 2]), "severity": rng.choice(["low", "HIGH", "critical", "odd", "Medium"]), "evidence": rng.choice(["one", "two", "one two", "", None, f"e{s % 7}"]), "status": rng.choice(["open", "open", "open", "confirmed", None]), "found_by": rng.choice([["m"], ["k", "m"], [], ["z"]]), "title": f"t{s % 3}"} for s in seqs]


def written(spark, tmp_path, source, schema, name="out"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = keyed.running_union(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / name / f"batch={n}")))
    out.trigger(availableNow=True).start().awaitTermination()
    return keyed.latest(spark.read.parquet(str(tmp_path / name)).drop("batch"))


def test_equals_the_fold_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = some(1, 60)
    source, everything = str(tmp_path / "in"), None
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    # out of order, the same rows again in a later batch, and a restart between
    for files in ((rows[40:], rows[:20]), (rows[20:40], rows[:20])):
        for part in files:
            batch = candidates(spark, part).coalesce(1)
            batch.write.mode("append").parquet(source)
        everything = spark.read.parquet(source)
        assert shape(written(spark, tmp_path, source, everything.schema)) == shape(union.fold(everything))
    assert everything.count() == 80
    # nothing new: nothing is written again
    assert shape(written(spark, tmp_path, source, everything.schema)) == shape(union.fold(everything))


def test_middle_is_the_aggregate(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([*severity.LEVELS, None]), rng.choice([0, 1, 2, 5])) for g in range(40) for _ in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "g int, level string, n int")
    got = {r["g"]: (r["m"], r["w"]) for r in df.groupBy("g").agg(severity.median_level(F.col("level")).alias("m"), severity.median_level(F.col("level"), F.col("n")).alias("w")).collect()}
    for g in range(40):
        one = [sum(1 for x in rows if x[:2] == (g, level)) for level in severity.LEVELS]
        many = [sum(x[2] for x in rows if x[:2] == (g, level)) for level in severity.LEVELS]
        assert got[g] == (severity.middle(one), severity.middle(many))
