"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a key: source, then document, then checksum, size and a running number, so no two keys are equal.
A record is drawn into a sample with a probability that is its share of the bytes (a large one surely), and the sample's
quantiles are the splitters: they bound ``ranges`` ranges of about equal bytes, far more than shards. A record's range is
found by two short searches, among the coarse splitters and among those of its coarse range, and records are partitioned
by range. Each range's exact rows and bytes are then counted. An overfull range (over ``slack`` times its share of the
bytes, its largest record aside, or of the rows, as where a third of all texts are empty) is subdivided at quantiles of a
sample of its own, drawn by bytes and rows. A shard is a run of whole ranges: those whose middle byte falls into its
share. So shards begin at splitters and nowhere else, order is the key's at any size, and a shard's bytes are off by half
a range at each end.

A task holds one range. The driver gets the splitters (``ranges`` keys; those of overfull ranges stay on the executors)
and a broadcast holds a row a range. Draws are arithmetic on the checksum and the id, so reruns agree.

Defined cases: a null text has size 1; a null source or id comes first; rows alike in key, size and checksum are
interchangeable; very long texts are never moved, only their sizes; an empty table gives an empty result; fewer records
than shards leave shards empty; other columns of the table aren't read, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, unit_hash, utf8

SHARDS = 8
#: Ranges, samples drawn for each, and by how much a range may exceed its share before it is subdivided.
RANGES, SAMPLES, SLACK = 1024, 32, 2.0
KEY = "struct<a:boolean,b:string,c:boolean,d:bigint,crc:bigint,size:bigint,tie:bigint>"
#: Factors of the draw (any large odd numbers below 2**30 do).
BY_CRC, BY_ID = 668265263, 374761393


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key: source (null first), doc_id (null first), checksum, size, running number."""
    text = utf8(F.col("text"))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    fields = {"a": F.col("source").isNotNull(), "b": F.coalesce("source", F.lit("")), "c": F.col("doc_id").isNotNull(), "d": F.coalesce("doc_id", F.lit(0)), "crc": F.col("text_crc32"), "size": F.col("size"), "tie": F.monotonically_increasing_id()}
    return lean.select("doc_id", "size", "text_crc32", F.struct(*(c.alias(n) for n, c in fields.items())).cast(KEY).alias("key"))


def draw() -> Column:
    """A number in [0, 1) that depends on the text's checksum and the id alone."""
    mixed = F.col("text_crc32") * BY_CRC + F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 31)) * BY_ID
    return F.pmod(mixed, F.lit(1 << 32)) / F.lit(float(1 << 32))


def _quantiles(keys: Column, n: Column) -> Column:
    """n - 1 of the sorted keys, or fewer where some are equal, that cut them into n parts of equal number."""
    cuts = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(keys, F.floor(i * F.size(keys) / n).cast("int")))
    return F.when(n > 1, F.array_distinct(F.filter(cuts, lambda x: x.isNotNull()))).otherwise(F.array().cast(f"array<{KEY}>"))


def splitters(rows: DataFrame, total_bytes: int, n: int, samples: int = SAMPLES) -> list[Row]:
    """n - 1 keys at most, quantiles of a sample in which a record lies with probability ``size * rate``, surely if large."""
    drawn = rows.where(draw() < F.col("size") * F.lit(n * samples / max(1, total_bytes)))
    # about n * samples keys, whatever the input; one row of n - 1 comes to the driver
    return drawn.agg(F.array_sort(F.collect_list("key")).alias("keys")).select(_quantiles(F.col("keys"), F.lit(n)).alias("cuts")).first()["cuts"]


def _below(cuts: Column, key: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= key))


def ranged(rows: DataFrame, cuts: list[Row]) -> DataFrame:
    """rows with ``range``: how many cuts are not above the key."""
    fine = max(1, int((len(cuts) + 1) ** 0.5))
    plain = [c.asDict() for c in cuts]
    nested = [plain[i : i + fine - 1] for i in range(0, len(plain) + 1, fine)]
    # constants of the plan: the firsts of the coarse ranges, and what cuts each
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    coarse = _below(constant(plain[fine - 1 :: fine], f"array<{KEY}>"), F.col("key"))
    found = rows.withColumn("coarse", coarse)
    inner = F.get(constant(nested, f"array<array<{KEY}>>"), F.col("coarse"))
    return found.withColumn("range", F.col("coarse") * fine + _below(inner, F.col("key"))).drop("coarse")


def subdivided(cut: DataFrame, total_bytes: int, total_rows: int, ranges: int, samples: int, slack: float) -> DataFrame:
    """cut with ``sub``: the part of an overfull range, by quantiles of its own sample; 0 in the others."""
    share, row_share = total_bytes / ranges, max(1.0, total_rows / ranges)
    held = cut.groupBy("range").agg(F.sum("size").alias("in_bytes"), F.max("size").alias("largest"), F.count("*").alias("in_rows"))
    over = held.where((F.col("in_bytes") - F.col("largest") > slack * share) | (F.col("in_rows") > slack * row_share))
    # a row for each overfull range, ``ranges`` at most
    parts = over.select(F.col("range").alias("of"), F.ceil(F.col("in_bytes") / share + F.col("in_rows") / row_share).cast("int").alias("parts"))
    chance = samples * (F.col("size") / F.lit(share) + F.lit(1 / row_share))
    drawn = cut.join(F.broadcast(parts), F.col("range") == F.col("of")).where(unit_hash(F.col("key"), F.lit("part")) < chance)
    keys = drawn.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.max("parts").alias("parts"))
    cuts = F.broadcast(keys.select(F.col("range").alias("of"), _quantiles(F.col("keys"), F.col("parts")).alias("cuts")))
    return cut.join(cuts, F.col("range") == F.col("of"), "left").withColumn("sub", F.coalesce(F.when(F.col("cuts").isNotNull(), _below(F.col("cuts"), F.col("key"))), F.lit(0))).drop("of", "cuts")


def sharded(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    rows = checkpointed(sized(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    cut = ranged(rows, splitters(rows, total["n"], ranges, samples))
    divided = checkpointed(subdivided(cut, total["n"], total["k"], ranges, samples, slack))
    # a row for each range and part, a few times ``ranges`` at most
    held = divided.groupBy(F.col("range").alias("r"), F.col("sub").alias("s")).agg(F.sum("size").alias("in_bytes"), F.count("*").alias("in_rows"))
    before = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumns({"bytes_before": F.coalesce(F.sum("in_bytes").over(before), F.lit(0)), "rows_before": F.coalesce(F.sum("in_rows").over(before), F.lit(0))})
    middle = 2 * F.col("bytes_before") + F.col("in_bytes")
    put = starts.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(1, total["n"])))).cast("int"))
    put = put.withColumn("start", F.col("rows_before") - F.min("rows_before").over(Window.partitionBy("shard"))).select("r", "s", "shard", "start")
    number = F.row_number().over(Window.partitionBy("range", "sub").orderBy("key")) - 1
    placed = divided.withColumn("row", number).join(F.broadcast(put), (F.col("range") == F.col("r")) & (F.col("sub") == F.col("s")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"))


#: sharded(documents) and the query's fixed columns in SQL, as far as no range is overfull; CRC-32 byte by byte.
ORACLE_SQL = """
WITH RECURSIVE bit AS (SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bit WHERE k < 8),
tbl AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
hexed AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT doc_id, source, CAST(length(x) // 2 + 1 AS BIGINT) AS size, list_transform(range(0, length(x) // 2), lambda j: CAST(strpos('123456789ABCDEF', substr(x, 2 * j + 1, 1)) * 16 + strpos('123456789ABCDEF', substr(x, 2 * j + 2, 1)) AS BIGINT)) AS bs FROM hexed),
sized AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM bytes, tbl),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, crc, size) AS pos, sum(size) OVER () AS total FROM sized),
sample AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS m FROM placed WHERE ((crc * 668265263 + coalesce(doc_id, 0) % 2147483648 * 374761393) % 4294967296) / 4294967296.0::DOUBLE < size * (32768.0::DOUBLE / total::DOUBLE)),
cuts AS (SELECT DISTINCT pos FROM sample WHERE i IN (SELECT (k * m) // 1024 FROM (SELECT unnest(range(1, 1024)) AS k), (SELECT any_value(m) AS m FROM sample))),
ranged AS (SELECT p.*, sum(CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY p.pos) AS r FROM placed p LEFT JOIN cuts c ON p.pos = c.pos),
held AS (SELECT r, sum(size) AS in_bytes, any_value(total) AS total FROM ranged GROUP BY r),
starts AS (SELECT r, in_bytes, total, coalesce(sum(in_bytes) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM held),
put AS (SELECT r, CAST(least(7, ((2 * before + in_bytes) * 8) // (2 * total)) AS INT) AS shard FROM starts)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM ranged JOIN put USING (r)
"""
