"""Packing: optimal length buckets, and token-budget batches in each.

The histogram of lengths over all documents (partial counts before the shuffle; at most ``budget`` bins) goes through
dynamic programming: among all ways to cut it into ``buckets`` ranges, the one with the least padding when every
document is padded to its bucket's largest length. The recurrence's cost is linear in the prefix counts, so each layer
is a lower envelope of lines and the whole takes buckets times bins steps. A document longer than the budget is alone in
its batch and never padded, whatever the buckets are, so it adds nothing to any sum and has no bin: the buckets are the
best for all documents.

A batch has as many documents of one bucket as fit the budget at the bucket's length. Documents of a bucket are numbered
in the order of doc_id by key ranges (``siftstone.llm.order``), at any size alike, so no task holds a bucket.

A document's length is its words plus one end mark. Defined cases: null and empty texts have length 1; documents longer
than the budget are alone in their batch; repeated rows are packed each for itself, those alike in doc_id and text in
any order; a null doc_id comes first; an empty table gives an empty result; other columns of the table go along in
``packed_rows`` whatever their names (an added column gives way to one of its name), and aren't read by ``packed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, col, n_words, snapshot
from siftstone.llm.order import in_order

BUDGET, BUCKETS = 16_384, 16


@dataclass(frozen=True)
class Line:
    """Cost of starting a bucket after bin ``cut``: slope times the bucket's length, plus offset."""

    slope: int
    offset: int
    cut: int


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Largest lengths of the buckets, ascending, for (length, count) pairs; padding is least, then buckets are fewest."""
    bins = sorted((n, c) for n, c in histogram if c > 0)
    m = len(bins)
    if not m:
        return []
    counts, lengths = [0], [0]
    for n, c in bins:
        counts.append(counts[-1] + c)
        lengths.append(lengths[-1] + n * c)
    infinite = float("inf")
    best: list[float] = [0, *[infinite] * m]
    cuts: list[list[int]] = []
    totals = [infinite]
    for _ in range(min(buckets, m)):
        hull: list[Line] = []
        layer: list[float] = [infinite] * (m + 1)
        cut = [0] * (m + 1)
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] < infinite:
                new = Line(-counts[j - 1], int(best[j - 1]) + lengths[j - 1], j - 1)
                # slopes fall, lengths grow: a line that is never least leaves the envelope
                while len(hull) - at >= 2 and (new.offset - hull[-2].offset) * (hull[-2].slope - hull[-1].slope) <= (hull[-1].offset - hull[-2].offset) * (hull[-2].slope - new.slope):
                    hull.pop()
                hull.append(new)
            if not hull:
                continue
            x = bins[j - 1][0]
            while at + 1 < len(hull) and hull[at + 1].slope * x + hull[at + 1].offset < hull[at].slope * x + hull[at].offset:
                at += 1
            layer[j] = hull[at].slope * x + hull[at].offset + x * counts[j] - lengths[j]
            cut[j] = hull[at].cut
        best = layer
        cuts.append(cut)
        totals.append(layer[m])
    k = min(range(1, len(totals)), key=lambda i: (totals[i], i))
    bounds, j = [], m
    for cut in reversed(cuts[:k]):
        bounds.append(bins[j - 1][0])
        j = cut[j]
    return bounds[::-1]


def placed(rows: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """rows (written ones, with doc_id, n_tokens and h) with bucket, bucket_tokens, batch (in its bucket), slot and padding."""
    # one row for each length up to the budget, and one for all above
    histogram = rows.groupBy(F.least("n_tokens", F.lit(budget + 1)).alias("n")).count().collect()
    bounds = optimal_bounds([(r["n"], r["count"]) for r in histogram if r["n"] <= budget], buckets)
    bounds_ = F.array(*(F.lit(int(x)) for x in bounds)).cast("array<bigint>")
    bucket = F.size(F.filter(bounds_, lambda b: b < F.col("n_tokens")))
    length = F.coalesce(F.get(bounds_, F.col("bucket")), F.col("n_tokens"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / length))
    numbered = in_order(rows.withColumn("bucket", bucket), ["doc_id", "n_tokens", "h"], within=["bucket"]).withColumns({"bucket_tokens": length, "room": room})
    out = numbered.withColumns({"batch": F.floor(F.col("place") / F.col("room")).cast("long"), "slot": F.pmod("place", "room").cast("int"), "padding": F.col("bucket_tokens") - F.col("n_tokens")})
    return out.select(*rows.columns, "bucket", "bucket_tokens", "batch", "slot", "padding")


def _lean(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("doc_id"), (n_words(text) + 1).alias("n_tokens"), F.xxhash64(text).alias("h")]


def packed(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch (in its bucket), slot and padding of each row."""
    return placed(checkpointed(docs.select(*_lean(F.col("doc_id"), F.col("text")))), budget, buckets).drop("h")


def packed_rows(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_tokens, bucket, bucket_tokens, batch, slot and padding after the given columns; where a given column has such a name, the added one has "_2", "_3", ... behind."""
    added = ("n_tokens", "bucket", "bucket_tokens", "batch", "slot", "padding")
    names = docs.columns
    taken = {n.lower() for n in names}
    free = [next(x for x in (a, *(f"{a}_{i}" for i in range(2, len(names) + 3))) if x not in taken) for a in added]
    kept = snapshot(docs.select(F.struct(*(col(n).alias(n) for n in names)).alias("row"), F.monotonically_increasing_id().alias("id")))
    lean = kept.select("id", *_lean(F.col("row.doc_id"), F.col("row.text")))
    found = placed(checkpointed(lean), budget, buckets).select(F.col("id").alias("of"), *added)
    return kept.join(found, F.col("id") == F.col("of")).select(*(F.col("row")[n].alias(n) for n in names), *(F.col(a).alias(x) for a, x in zip(added, free, strict=True)))


#: packed(documents) in SQL.
ORACLE_SQL = r"""
WITH RECURSIVE tok AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS n, count(*) AS c FROM tok WHERE n_tokens <= 16384 GROUP BY n_tokens),
bins AS (SELECT row_number() OVER w AS j, n, CAST(sum(c) OVER w AS BIGINT) AS cc, CAST(sum(n * c) OVER w AS BIGINT) AS ss FROM h WINDOW w AS (ORDER BY n)),
dp AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS cc, CAST(0 AS BIGINT) AS ss
UNION ALL SELECT dp.k + 1, b.j, min(dp.cost + b.n * (b.cc - dp.cc) - (b.ss - dp.ss)), arg_min(dp.j, dp.cost + b.n * (b.cc - dp.cc) - (b.ss - dp.ss)), any_value(b.cc), any_value(b.ss) FROM dp JOIN bins b ON b.j > dp.j WHERE dp.k < 16 GROUP BY dp.k, b.j),
best AS (SELECT k, j FROM dp WHERE k > 0 AND j = (SELECT max(j) FROM bins) ORDER BY cost, k LIMIT 1),
tr AS (SELECT k, j FROM best UNION ALL SELECT dp.k - 1, dp.cut FROM tr JOIN dp ON dp.k = tr.k AND dp.j = tr.j WHERE tr.k > 1),
bounds AS (SELECT b.n, CAST(row_number() OVER (ORDER BY b.n) - 1 AS INT) AS bucket FROM tr JOIN bins b ON b.j = tr.j),
put AS (SELECT doc_id, n_tokens, coalesce((SELECT min(bucket) FROM bounds WHERE n >= n_tokens), (SELECT CAST(count(*) AS INT) FROM bounds)) AS bucket, coalesce((SELECT min(n) FROM bounds WHERE n >= n_tokens), n_tokens) AS bucket_tokens FROM tok),
pl AS (SELECT *, greatest(1, 16384 // bucket_tokens) AS room, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS place FROM put)
SELECT doc_id, n_tokens, bucket, bucket_tokens, CAST(place // room AS BIGINT) AS batch, CAST(place % room AS INT) AS slot, bucket_tokens - n_tokens AS padding FROM pl
"""
