"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document is described by ratios and counts of its whole text; labels, ids, language and source are no inputs. The
statistics of a bounded sample of labelled documents (``max_rows``, the least by a hash of the id; the only bound, and
on training alone) come to the driver, are cut into quantile bins, and trees of a fixed depth are grown one after
another on the logistic loss's gradients from bin histograms. The forest is flattened into arrays, one for features,
thresholds and leaf values each, and every document is scored by walking all trees level by level in numpy.

Training is deterministic, so a rerun gives the same scores, and equal texts score alike.

Defined cases: a null text is an empty one; an empty text gets statistics of zeros and a score; of several labels of a
document the lower quality counts; labels without a document or quality are left out; if no label is there, or only
one kind, every score is the share of label 1 (0.5 without any); very long texts are read whole; repeated rows get
the same score; an empty table gives an empty result; other columns go along in ``accepted``, whatever their names, and
aren't read by ``classified``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import col, utf8, with_fields

MAX_ROWS, TREES, DEPTH, BINS, RATE, LEAST, L2 = 20_000, 120, 4, 64, 0.1, 8.0, 1.0
HELD_OUT, THRESHOLD = 5, 0.3

_KINDS = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\f", "line": b"\n", "stop": b".,;:", "shout": b"!?", "mark": b"#*$%&|<>", "bracket": b"()[]{}\"'", "joiner": b"-_/\\=+~^@`", "control": bytes(i for i in range(32) if i not in b"\t\n\r\x0b\f") + b"\x7f"}
STATISTICS = ("log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "most_frequent_word", "repeated_pairs", "lines_repeated", "words_in_line", "compression", "entropy", "wide", "words_with_mark", "words_upper", "words_with_digit", "longest_word", *_KINDS)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(members)] = 1
    return out


_IS_SPACE, _IS_MARK, _IS_DIGIT, _IS_UPPER, _IS_LOWER = (_table(x) for x in (b" \n\t\r\x0b\f", _KINDS["mark"], _KINDS["digit"], _KINDS["upper"], _KINDS["lower"]))


def statistics(text: bytes) -> list[float]:
    """What the classifier knows of a text; all of it is read."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text, dtype=np.uint8)
    by_byte = np.bincount(data, minlength=256)
    share = by_byte[by_byte > 0] / n
    kinds = [float(by_byte[list(k)].sum()) / n for k in _KINDS.values()]
    general = [len(zlib.compress(text, 1)) / n, -float((share * np.log2(share)).sum()), float(by_byte[128:].sum()) / n]
    words = text.split()
    w = len(words)
    if not w:
        return [float(np.log1p(n)), *[0.0] * 8, *general, *[0.0] * 4, *kinds]
    edge = np.flatnonzero(np.diff(_IS_SPACE[data], prepend=1, append=1))
    starts = edge[::2]
    lengths = edge[1::2] - starts
    marked, digits, upper, lower = (np.add.reduceat(t[data], starts, dtype=np.int64) > 0 for t in (_IS_MARK, _IS_DIGIT, _IS_UPPER, _IS_LOWER))
    seen = Counter(words)
    pairs = 1 - len(set(zip(words, words[1:], strict=False))) / (w - 1) if w > 1 else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    by_word = [lengths.mean(), lengths.std(), len(seen) / w, max(seen.values()) / w, pairs, 1 - len(set(lines)) / len(lines), w / len(lines)]
    shares = [marked.mean(), (upper & ~lower & (lengths > 1)).mean(), digits.mean(), lengths.max()]
    return [*map(float, (np.log1p(n), np.log1p(w), *by_word, *general, *shares)), *kinds]


@dataclass(frozen=True)
class Forest:
    """Trees of one depth, flattened: node i's children are 2i + 1 and 2i + 2; leaves follow the inner nodes."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:  # all rows are at one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = LEAST, l2: float = L2) -> Forest:
    """A forest for labels 0 and 1; rows are taken as they come, so the order of rows doesn't matter beyond rounding."""
    inner, n_features = (1 << depth) - 1, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    mean = float(y.mean()) if len(y) else 0.5
    if mean in (0.0, 1.0) or not len(y):
        base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(n_features) * bins
    width = n_features * bins
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n_nodes = (1 << level) - 1, 1 << level
            at = ((node - first) * width)[:, None] + flat
            g = np.bincount(at.ravel(), np.repeat(gradient, n_features), n_nodes * width).reshape(n_nodes, n_features, bins)
            h = np.bincount(at.ravel(), np.repeat(weight, n_features), n_nodes * width).reshape(n_nodes, n_features, bins)
            gl, hl = g.cumsum(axis=2)[..., :-1], h.cumsum(axis=2)[..., :-1]
            ga, ha = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(hl < least / 4) | (ha - hl < least / 4)] = -1
            best = gain.reshape(n_nodes, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, cut = divmod(b, bins - 1)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                    features[t, first + k], thresholds[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        values[t] = rate * g / (h + l2)
        total += values[t][leaf]
    return Forest(base, features, thresholds, values)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of HELD_OUT; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def sampled_labels(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, quality) of the max_rows labelled documents outside the held-out part with the least hashes of their ids."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("of"), "quality")
    known = known.where(~held_out(F.col("of"))).groupBy("of").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("of"), "of").limit(max_rows)
    # max_rows rows of two numbers: a proven bound
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", utf8(F.col("text")).alias("text"), "quality")


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, batch.column(2)], ["doc_id", "x", "y"])

    rows = sampled_labels(docs, labels, max_rows).select("doc_id", "text", F.col("quality").cast("double").alias("y")).mapInArrow(read, "doc_id long, x array<double>, y double")
    # repeated ids can only add copies of a sampled row; the least of each keeps the bound
    found = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").toArrow()
    if not found.num_rows:
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0))
    order = np.argsort(found["doc_id"].to_numpy())
    x = np.array(found["x"].to_pylist())[order]
    return train(x, (found["y"].to_numpy()[order] > 0.5).astype(float))


def scored(docs: DataFrame, forest: Forest, keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (doc_id if none are named) with the score of the text."""
    kept = keep or [F.col("doc_id")]
    given = docs.select(F.struct(*kept).alias("row"), utf8(F.col("text")).alias("body"))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(x))], ["row", "score"])

    return given.mapInArrow(read, with_fields({"row": given.schema["row"].dataType}, "score double"))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    rows = scored(docs, fitted(docs, labels))
    return rows.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted to be of low quality."""
    rows = scored(docs, fitted(docs, labels), [col(c).alias(c) for c in docs.columns])
    return rows.where(predicted(F.col("score")) == 1).select(*(F.col("row")[c].alias(c) for c in docs.columns))
