"""Which knowledge fits a diff or a repository: triggers, guide signals and the top few."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from siftstone.functions.automaton import Automaton
from siftstone.functions.text import glob_regex_sql
from siftstone.session import checkpointed

TOP = 6
#: Rows of knowledge that may be broadcast, and bytes of needles.
LIMIT, BYTES = 10_000, 4_000_000
#: Bytes of texts that are searched at once.
PIECE = 4_000_000
#: Impact ranks; an unknown impact ranks 1.
IMPACT = {"critical": 3, "high": 2, "medium": 1, "low": 0}


def in_parts(small: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """A table that is about to be broadcast, whole if it is known to have no more rows than the limit, else in parts by a hash that are."""
    if small.limit(limit + 1).count() <= limit:
        return [F.broadcast(small)]
    n = -(-2 * small.count() // limit)
    row = F.xxhash64(*small.columns)
    return [part for i in range(n) for part in in_parts(small.where(F.pmod(row, F.lit(n)) == i).distinct(), limit)]


def gathered_parts(small: DataFrame, needle: str, limit: int = LIMIT, most: int = BYTES) -> list[list[Row]]:
    """The rows of a table, in parts of at most ``limit`` rows and ``most`` bytes of needles (or one needle); at least one part."""
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(needle)), F.lit(0)).alias("bytes")).first()
    if size["n"] <= limit and size["bytes"] <= most or size["n"] == 1:
        return [small.collect()]
    numbered = small.withColumn("_part", F.pmod(F.xxhash64(*small.columns, F.monotonically_increasing_id()), F.lit(max(2, -(-2 * size["n"] // limit), -(-2 * size["bytes"] // most)))))
    numbered = checkpointed(numbered)
    parts = [r["_part"] for r in numbered.select("_part").distinct().collect()]
    return [rows for i in sorted(parts) for rows in gathered_parts(numbered.where(F.col("_part") == i).drop("_part"), needle, limit, most)]


def met(left: DataFrame, small: DataFrame, on: Callable[[], Column], limit: int = LIMIT) -> DataFrame:
    """left joined to a small table on a condition without a key, a part of it at a time."""
    return reduce(DataFrame.unionByName, (left.join(part, on()) for part in in_parts(small, limit)))


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows, from and to, of at most so many bytes each, or of one row."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def contained(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle", limit: int = LIMIT, most: int = BYTES) -> DataFrame:
    """(columns of texts but the text, columns of needles) for each row of texts and each needle that its text contains.

    Containment has no key to join on, so all needles are looked for in one reading of each text, by an automaton
    (``siftstone.functions.automaton``) whose size is the needles', not the texts'. Needles are knowledge, a small table:
    its rows and bytes are checked against ``limit`` and ``most`` before they are gathered and broadcast, and a larger one
    goes in parts of that size. Null and empty needles are in no text, null texts contain none; repeated rows count each.
    """
    spark, rest = texts.sparkSession, [c for c in texts.columns if c != text]
    kinds = StructType([texts.schema[c] for c in rest])
    out = []
    for part in gathered_parts(needles.where(F.col(needle) != ""), needle, limit, most):
        automaton = spark.sparkContext.broadcast(Automaton.of([r[needle].encode() for r in part]))

        def search(batches: Iterator[pa.RecordBatch], automaton: Broadcast = automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
                data = column.buffers()[2]
                # what is held is some bytes for each byte of a piece, whatever the size of the batch
                for a, b in pieces(offsets):
                    row, found = automaton.value.found(data[offsets[a] : offsets[b]].to_pybytes() if data else b"", offsets[a : b + 1] - offsets[a])
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row + a)) for c in batch.columns[1:]), pa.array(found.astype(np.int32))], [*rest, "_needle"])

        hits = texts.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"), *rest).mapInArrow(search, StructType([*kinds, StructField("_needle", IntegerType())]))
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(part)], StructType([StructField("_number", IntegerType()), *needles.schema]))
        out.append(hits.join(F.broadcast(numbered), F.col("_needle") == F.col("_number")).drop("_needle", "_number"))
    return reduce(DataFrame.unionByName, out)


def triggered(diffs: DataFrame, triggers: DataFrame) -> DataFrame:
    """(diff_id, vuln_id) where the diff's text in lower case contains one of the class's triggers."""
    lower = diffs.select("diff_id", F.lower("text").alias("text"))
    return contained(lower, triggers.select("vuln_id", F.col("trigger").alias("needle"))).select("diff_id", "vuln_id").distinct()


def top_classes(hits: DataFrame, vulns: DataFrame, k: int = TOP) -> DataFrame:
    """The k classes of each diff of the highest impact, of equal ones the last by id; ``place`` counts from 1.

    Only ids and ranks meet in a group, at most one row a class.
    """
    rank = F.lit(1)
    for name, value in IMPACT.items():
        rank = F.when(F.lower("impact") == name, value).otherwise(rank)
    ranked = hits.join(vulns.select(F.col("id").alias("vuln_id"), rank.alias("rank")), "vuln_id")
    best = ranked.groupBy("diff_id").agg(F.slice(F.reverse(F.array_sort(F.collect_set(F.struct("rank", "vuln_id")))), 1, k).alias("best"))
    return best.select("diff_id", F.posexplode("best").alias("place", "x")).select("diff_id", (F.col("place") + 1).alias("place"), "x.vuln_id", "x.rank")


def select_guides(files: DataFrame, manifests: DataFrame, sources: DataFrame, guides: DataFrame, signals: DataFrame) -> DataFrame:
    """Guides (seq, id) of which any signal fires, in order. signals: (guide_id, signal, pattern).

    signal ``file``: a glob on paths; ``manifest``: contained in a manifest in lower case; ``import`` and ``content``:
    contained in a source text in lower case (an import with capitals never is).
    """
    of = lambda *kinds: signals.where(F.col("signal").isin(*kinds)).select("guide_id", F.col("pattern").alias("needle"))
    globs = of("file").withColumn("needle", glob_regex_sql(F.col("needle")))
    by_path = met(files.select("path"), globs, lambda: F.rlike(F.col("path"), F.col("needle"))).select("guide_id")
    by_manifest = contained(manifests.select(F.lower("text").alias("text")), of("manifest")).select("guide_id")
    by_source = contained(sources.select(F.lower("text").alias("text")), of("import", "content")).select("guide_id")
    fired = by_path.unionByName(by_manifest).unionByName(by_source).distinct()
    return guides.join(fired, F.col("id") == F.col("guide_id"), "left_semi").orderBy("seq")


def bodies(chosen: DataFrame, docs: DataFrame, group: str = "diff_id", order: str = "place", key: str = "vuln_id") -> DataFrame:
    """(group, text): the bodies of the chosen notes (id, body), in order. A diff has few."""
    rows = chosen.join(docs.select(F.col("id").alias(key), "body"), key)
    ordered = F.array_sort(F.collect_list(F.struct(order, "body")))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("text"))


def flattened(guides: DataFrame, column: str) -> DataFrame:
    """(value) of the guides' lists in the order of guides (seq) and lists, each value once, where it comes first."""
    rows = guides.select("seq", F.posexplode(column).alias("n", "value")).groupBy("value").agg(F.min(F.struct("seq", "n")).alias("first"))
    return rows.orderBy("first").select("value")


def allowed_categories(vulns: DataFrame) -> DataFrame:
    return vulns.select("id").distinct()
