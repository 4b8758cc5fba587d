"""Importance resampling towards a target distribution: word n-grams in hashed buckets, weights, and a draw.

A feature is a run of one to ``longest`` consecutive words of a text, its bucket a checksum of it modulo ``buckets``.
How often the documents and the target's texts hit each bucket gives the bucket's gain; a document's weight is the sum
of its features' gains, and the draw takes the documents of the highest weights, each with Gumbel noise from its id.

The texts are read twice, once for the counts and once for the weights, and never shuffled. Either time a task takes
blocks of about ``WORDS`` words, turns words into numbers, and sorts the places by the words that begin there: the
block's suffix array to the depth of the longest feature. Neighbours in it with a common prefix of k words and more
are one run of the same k-gram, so a run's bucket is found once; the counts add runs' lengths, the weights scatter the
runs' buckets back to the places. A run's checksum comes from those of its words: CRC-32 is linear, so that of two
strings end to end is the first one's, moved on by the second's length, in exclusive or with the second's.

Counts of buckets, ``buckets`` of them whatever the input is, go through the driver; places in the draw go by key ranges.

Defined cases: null and empty texts have no feature, weight 0 and no rank, and a text of fewer words than a feature has
none of that length; a very long text is a block of its own size; equal scores go by doc_id, a null one last, and rows
alike in both in any order; repeated rows are documents each for itself; a null doc_id's noise is that of an empty one; an
empty table gives an empty result, an empty target counts nothing; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, utf8
from siftstone.llm.order import in_order
from siftstone.llm.words import Vocabulary, texts, words

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
WORDS = 1_000_000

#: CRC-32's polynomial, lowest power at the highest bit.
POLYNOMIAL = 0xEDB88320


def _times(operator: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear operator on 32 bits, as what each byte value of each byte place becomes, on each of x."""
    out = operator[0][x & 255]
    for i in (1, 2, 3):
        out = out ^ operator[i][x >> np.uint32(8 * i) & 255]
    return out


def _one_byte() -> np.ndarray:
    """What a zero byte after a string does to its checksum."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = register >> np.uint32(1) ^ np.where(register & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    moved = np.arange(256, dtype=np.uint32)
    return np.stack([register, moved, moved << np.uint32(8), moved << np.uint32(16)])


class Checksums:
    """CRC-32 of words end to end with spaces, from the words' own."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        held = list(vocabulary)
        self.word = np.fromiter(map(zlib.crc32, held), np.uint32, len(held))
        self.spaced = np.fromiter((zlib.crc32(b" " + w) for w in held), np.uint32, len(held))
        lengths, self.kind = np.unique(np.fromiter(map(len, held), np.int64, len(held)) + 1, return_inverse=True)
        # moving on by a length is moving on by the powers of two in it
        every = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
        moves, power, left = np.repeat(every[None], len(lengths), axis=0), _one_byte(), lengths.copy()
        while left.any():
            odd = left % 2 == 1
            moves[odd] = _times(power, moves[odd])
            power, left = _times(power, power), left // 2
        self.moves = moves.transpose(1, 0, 2).reshape(4, -1)

    def followed(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The checksums of strings with a space and a word after them."""
        row = self.kind[word] << 8
        out = self.spaced[word]
        for i in range(4):
            out = out ^ self.moves[i][row | (crc >> np.uint32(8 * i) & 255)]
        return out


class Block:
    """Texts with their suffix array to the depth ``longest``; numbers of words count from 1, 0 ends a text."""

    def __init__(self, found: list[list[bytes]], longest: int) -> None:
        self.vocabulary, self.longest = Vocabulary(), longest
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        parts = []
        for text in found:
            parts += [self.vocabulary.numbers(text) + 1, np.zeros(1, np.int64)]
        stream = np.concatenate([*parts, np.zeros(longest, np.int64)])
        places = np.flatnonzero(stream)
        following = [stream[places]]
        for k in range(1, longest):
            following.append(np.where(following[-1] > 0, stream[places + k], 0))
        self.following = following
        bits = len(self.vocabulary).bit_length()
        if bits * longest < 64:
            key = following[0]
            for w in following[1:]:
                key = key << bits | w
            self.order = np.argsort(key)
        else:
            self.order = np.lexsort(following[::-1])

    def runs(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: where runs of places with the same words begin in the order, the bucket of each, and whether it is a feature."""
        checksums = Checksums(self.vocabulary)
        begins = np.zeros(len(self.order), dtype=bool)
        begins[:1] = True
        for k, w in enumerate(self.following):
            sorted_ = w[self.order]
            begins[1:] |= sorted_[1:] != sorted_[:-1]
            at = np.flatnonzero(begins)
            whole = sorted_[at] > 0
            if k:
                crc = crc[np.searchsorted(before, at, side="right") - 1]
                crc[whole] = checksums.followed(crc[whole], sorted_[at][whole] - 1)
            else:
                crc = checksums.word[sorted_[at] - 1]
            before = at
            yield at, (crc % np.uint32(buckets)).astype(np.int64), whole

    def counts(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for at, bucket, whole in self.runs(buckets):
            np.add.at(out, bucket[whole], np.diff(at, append=len(self.order))[whole])
        return out

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Each text's sum of its features' gains."""
        at_place = np.zeros(len(self.order), np.int64)
        for at, bucket, whole in self.runs(len(gains)):
            at_place[self.order] += np.repeat(np.where(whole, gains[bucket], 0), np.diff(at, append=len(self.order)))
        ends = np.cumsum(self.lengths)
        total = np.concatenate([[0], np.cumsum(at_place)])
        return total[ends] - total[ends - self.lengths]


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[tuple[list[int | None], Block]]:
    ids, found, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), texts(batch.column("text")), strict=True):
            ids.append(doc_id)
            found.append(words(text))
            n += len(found[-1]) + 1
            if n >= size:
                yield ids, Block(found, longest)
                ids, found, n = [], [], 0
    if ids:
        yield ids, Block(found, longest)


def bucket_counts(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, size: int = WORDS) -> tuple[np.ndarray, int]:
    """Features in each bucket over all rows (id, text), and how many rows have ``least`` words or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, long = np.zeros(buckets, np.int64), 0
        for _, block in _blocks(batches, longest, size):
            total += block.counts(buckets)
            long += int((block.lengths >= least).sum())
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": np.append(hit, -1), "n": np.append(total[hit], long)})

    out, long = np.zeros(buckets, np.int64), 0
    for r in rows.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            long = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, long


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, one feature added to each."""
    n = len(source)
    s_all, t_all = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all) / (float(s + 1) * float(t_all)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _weigher(gains: np.ndarray, longest: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches, longest, size):
            features = sum(np.maximum(0, block.lengths - k) for k in range(longest))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_words": block.lengths, "n_features": features, "weight": block.weights(gains)})

    return weighed


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED, size: int = WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank counts from 1 in the draw and is null outside."""
    lean = docs.select(F.col("doc_id").cast("long").alias("id"), utf8(F.col("text")).alias("text"))
    source, long = bucket_counts(lean, longest, buckets, least, size)
    aimed, _ = bucket_counts(target.select(F.lit(None).cast("long").alias("id"), utf8(F.col("text")).alias("text")), longest, buckets, least, size)
    weighed = lean.mapInArrow(_weigher(gains_of(source, aimed), longest, size), "doc_id long, n_words long, n_features long, weight long")
    keyed = weighed.select("doc_id", "n_features", "weight", (F.col("n_words") < least).alias("short"), F.col("doc_id").isNull().alias("unnamed"), (-(F.col("weight") + noise(F.col("doc_id"), seed))).alias("falling"))
    # written before the ranges are drawn from it, so the texts are weighed once
    ordered = in_order(checkpointed(keyed), ["short", "falling", "unnamed", "doc_id"])
    rank = F.when(F.col("place") < long * percent // 100, F.col("place") + 1)
    return ordered.select("doc_id", "n_features", "weight", (-F.col("falling")).alias("score"), rank.alias("rank"))


#: resampled(documents, benchmark) in SQL, CRC-32 byte by byte.
ORACLE_SQL = r"""
WITH RECURSIVE bit AS (SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bit WHERE k < 8),
tbl AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(ws, list_transform(range(1, greatest(1, len(ws))), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, greatest(1, len(ws) - 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
hexed AS (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM n),
bytes AS (SELECT feature, list_transform(range(0, length(x) // 2), lambda j: CAST(strpos('123456789ABCDEF', substr(x, 2 * j + 1, 1)) * 16 + strpos('123456789ABCDEF', substr(x, 2 * j + 2, 1)) AS BIGINT)) AS bs FROM hexed),
crc AS (SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tbl),
hit AS (SELECT side, id, bucket, CAST(sum(n) AS BIGINT) AS n FROM n JOIN crc USING (feature) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM hit GROUP BY bucket),
al AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b, al),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM hit JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
h AS (SELECT w.id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (id) WHERE side = 0),
sc AS (SELECT id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS eligible FROM sc WHERE words >= 20)
SELECT sc.id AS doc_id, n_features, weight, score, CASE WHEN rank <= 5 * eligible // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (id)
"""
