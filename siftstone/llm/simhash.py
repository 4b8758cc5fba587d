"""SimHash near-duplicates: fingerprints, pigeonhole block joins, Hamming checks and connected components.

A text's A-Z are lower-cased, its words taken, its four-word shingles hashed (XXH64, seed 42), and a bit of the
fingerprint is set if it is set in over half the hashes. Two fingerprints within ``max_bits`` differing bits share
``blocks - max_bits`` of ``blocks`` blocks, so a table for each choice of that many blocks brings every such pair
together once at least.

Copies and equal fingerprints are collapsed first; only 8-byte distinct fingerprints travel to the blocks. Blocks are
counted before they meet, and one of over ``hot`` members is cut again by the same pigeonhole: its members agree in the
block's bits, so those within ``max_bits`` agree in one of ``max_bits + 1`` parts of the other bits, too. This is repeated
until no block is hot or so few bits are left that a block is small by itself, so no task holds a popular block whole and
no pair is lost. Inside a block the search takes one member, removes what it links to from the unseen ones, and goes on from there, so a dense
group of n near copies costs about n comparisons and gives n - 1 links, never all pairs; a group that shares a block
without being alike gives none. Components of the links follow by distributed star steps.

Defined cases: null and empty texts (and those without a word) have fingerprint zero and are linked like any other;
fewer than four words make one shingle; repeated rows stay, with the same result; a null doc_id gets no say in the
component's id but gets one; very long texts are hashed whole; an empty table gives an empty result; other columns of
the table aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, col, part, utf8, with_fields
from siftstone.llm.components import components
from siftstone.llm.jaccard import near_copies

SHINGLE, SEED, MAX_BITS, BLOCKS = 4, 42, 4, 7
#: Members above which a block is cut again, and free bits below which it needs no cut (2 ** 12 members at most).
HOT, FREE_BITS = 4096, 12
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes. bytes.split() parts at ASCII white space alone."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of each row's whole text as a signed long."""

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text")).mapInArrow(batches, with_fields({"key": docs.schema[key].dataType}, "fp long"))


def _masks(blocks: int, kept: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(members: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (a, b) within max_bits that connect just those members that any chain of such links connects.

    Members are distinct. A member that was reached is compared with those not reached yet only.
    """
    unseen, found = members, []
    while len(unseen):
        frontier, unseen = [unseen[0]], unseen[1:]
        while frontier and len(unseen):
            at = frontier.pop()
            near = np.bitwise_count(unseen ^ at) <= max_bits
            if near.any():
                reached = unseen[near]
                found.append(np.stack([np.full(len(reached), at, dtype=np.uint64), reached]))
                frontier.extend(reached)
                unseen = unseen[~near]
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)


def _parts(mask: int, n: int) -> list[int]:
    """The mask with each of n parts of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // n for i in range(n + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _cut(n: int):
    """Rows (fp, mask, block, t) of rows (fp, mask, block): one for each of n parts of the mask's free bits."""

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in it:
            masks = batch.column(1).to_pylist()
            parts = [known.get(m) or known.setdefault(m, [_signed(p) for p in _parts(m & (1 << 64) - 1, n)]) for m in masks]
            again = pa.array(np.repeat(np.arange(len(masks)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array([p for ps in parts for p in ps], pa.int64()), batch.column(2).take(again), pa.array(np.tile(np.arange(n, dtype=np.int32), len(masks)))], ["fp", "mask", "block", "t"])

    return read


def _verify(max_bits: int):
    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            out = [spanning_links(x, max_bits) for x in np.split(values, ends[:-1])]
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return read


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints (fp), enough to connect each component."""
    # 8 bytes a row become many: dealt out before, so that no few tasks make all of them; by a hash of fp, as an exchange
    # by fp itself would be taken for the one below it, whose small partitions are merged
    distinct = distinct.repartition(max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("fp"))
    masks = F.array(*(F.lit(_signed(m)) for m in _masks(blocks, blocks - max_bits)))
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "mask", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("block"))
    out = []
    while True:
        able = keyed.where(F.lit(64) - F.bit_count("mask") > FREE_BITS)
        crowded = checkpointed(able.groupBy("block", part(F.col("block"))).count().where(F.col("count") > hot).select(F.col("block").alias("of")))
        some = not crowded.isEmpty()
        cool = keyed.join(crowded, F.col("block") == F.col("of"), "left_anti") if some else keyed
        out.append(cool.groupBy("block").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps").mapInArrow(_verify(max_bits), "a long, b long"))
        if not some:
            return reduce(DataFrame.unionByName, out).distinct()
        finer = keyed.join(crowded, F.col("block") == F.col("of")).select("fp", "mask", "block").mapInArrow(_cut(max_bits + 1), "fp long, mask long, block long, t int")
        keyed = checkpointed(finer.select("fp", "mask", F.xxhash64("block", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("block")))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable by links."""
    prints = checkpointed(fingerprints(docs, text, key))  # the texts are hashed once
    first = prints.groupBy("fp").agg(F.min("key").alias("least"))
    labels = components(links(first.select("fp"), max_bits, blocks, hot))
    # each linked fingerprint with its component, then the least key of the component; unlinked ones are their own
    grouped = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component", part(F.col("component"))).agg(F.min("least").alias("component_id")).drop("_part")
    by_print = grouped.join(least, "component").select(F.col("fp").alias("of"), "component_id")
    return prints.join(by_print, prints["fp"] == by_print["of"]).select("key", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies (``jaccard``): the one of the smallest doc_id (null first; of equal ones, by the text's hash)."""
    names = docs.columns
    # a row is told by its id and its text's MD5; only rows alike in both can be taken for one another
    key = F.struct(F.col("doc_id").alias("doc_id"), F.md5(utf8(F.col("text"))).alias("text_md5"), F.col("text").isNull().alias("null"))
    winners = near_copies(docs.select(key.alias("key"), "text")).select(F.col("component_id").alias("winner")).distinct()
    rows = docs.select(F.struct(*(col(c).alias(c) for c in names)).alias("row"), key.alias("key")).join(winners, F.col("key") == F.col("winner"), "left_semi")
    # rows alike: one of them, by the other columns' hash; a partial aggregate, so any number of them is no task's alone
    kept = rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in names))
