"""Ranked lexical search: dual-sorted wavelet trees by shard, searched best first.

Two passes over the texts make an index: the first counts documents with a term and all terms, which impacts need, the
second writes it. A shard is a run of documents of one task, as many as have about ``TOKENS`` terms together; the
texts aren't shuffled. Its row has the terms, where each one's list begins, the impacts, the tree
(``siftstone.llm.wavelet``) and the documents' ids, whose order is that of the document numbers. An impact is
``(10^9 tf) div (1000 tf + 12 m)`` with m from the document's length against the mean one; terms' weights aren't in it,
so the index serves any set of items.

Items come in parts of at most ``ITEM_TERMS`` terms (and one item more). For a part, its terms' document frequencies are
added up over the shards' dictionaries, then each shard is searched for each item: nodes of the tree are opened in the
order of their bounds until none can reach the k-th score. A task keeps an item's k best so far, whose least is the
next shard's bar, and hands on k rows an item; the k best of those are the result. It is exact, whatever the shards are.

Defined cases: a null or empty text has no term, so such a document counts nowhere and is never found, and such an item
has no row; a very long text is one document of a shard of its own size; repeated rows are documents, or items, each for
itself; equal scores go by doc_id, a null one last, and rows alike in both in any order; no documents or no items give an
empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm import wavelet
from siftstone.llm.common import place, utf8
from siftstone.llm.order import in_order
from siftstone.llm.words import Vocabulary, counts, texts, words

K, TOKENS, ITEM_TERMS = 20, 1_000_000, 100_000
#: A shard numbers its documents in so many bits, and impacts are below 2^20.
DOC_BITS, IMPACT_BITS = 16, 20
INDEX = "terms array<binary>, starts binary, impacts binary, bits binary, docs binary, named binary, n_docs int"


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + 25 * length * self.documents // max(1, self.terms)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def corpus(docs: DataFrame) -> Corpus:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = terms = 0
        for batch in batches:
            n = counts(batch.column("text"))
            some, terms = some + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"documents": [some], "terms": [terms]})

    found = docs.select(utf8(F.col("text")).alias("text")).mapInArrow(counted, "documents long, terms long")
    return Corpus(*found.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


class _Shard:
    """Documents of a shard in the making."""

    def __init__(self) -> None:
        self.vocabulary, self.keys, self.ids, self.lengths, self.tokens = Vocabulary(), [], [], [], 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        self.keys.append(self.vocabulary.numbers(found) << DOC_BITS | len(self.ids))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.tokens += len(found)

    def full(self, tokens: int) -> bool:
        return self.tokens >= tokens or len(self.ids) == 1 << DOC_BITS

    def row(self, of: Corpus) -> pa.RecordBatch:
        named = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~named))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        pairs, tf = np.unique(np.concatenate(self.keys), return_counts=True)
        old = pairs & (1 << DOC_BITS) - 1
        falling = (1 << IMPACT_BITS) - 1 - of.impact(tf.astype(np.int64), np.array(self.lengths, np.int64)[old])
        postings = np.sort((pairs >> DOC_BITS << IMPACT_BITS | falling) << DOC_BITS | number[old])
        impacts = ((1 << IMPACT_BITS) - 1 - (postings >> DOC_BITS & (1 << IMPACT_BITS) - 1)).astype(np.int32)
        starts = np.searchsorted(postings >> DOC_BITS + IMPACT_BITS, np.arange(len(self.vocabulary) + 1))
        bits = wavelet.level_bits((postings & (1 << DOC_BITS) - 1).astype(np.int32), wavelet.depth_of(len(ids)))
        values = {"starts": starts.astype(np.int32).tobytes(), "impacts": impacts.tobytes(), "bits": bits, "docs": ids[order].tobytes(), "named": named[order].tobytes()}
        columns = {"terms": pa.array([list(self.vocabulary)], pa.list_(pa.binary()))} | {k: pa.array([v], pa.binary()) for k, v in values.items()}
        return pa.RecordBatch.from_pydict(columns | {"n_docs": pa.array([len(ids)], pa.int32())})


def index(docs: DataFrame, of: Corpus, tokens: int = TOKENS) -> DataFrame:
    """The shards of the index, a row each, written to the shared folder."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                if found := words(text):
                    shard.add(doc_id, found)
                    if shard.full(tokens):
                        yield shard.row(of)
                        shard = _Shard()
        if shard.ids:
            yield shard.row(of)

    spark, path = docs.sparkSession, place(docs.sparkSession, "index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(built, INDEX)
    # rows are some MB each, so the size of what is held is looked at after every one
    rows.write.option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 1).option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _numbers(buffer: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(buffer.as_buffer(), kind)


def frequencies(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents have each of the terms."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for held, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                at = pc.index_in(wanted, value_set=held.values.cast(pa.binary())).fill_null(-1).to_numpy()
                total += np.where(at < 0, 0, np.diff(_numbers(starts, np.int32))[at])
        yield pa.RecordBatch.from_pydict({"term": wanted, "df": total})

    # a row for each term of the part
    found = shards.select("terms", "starts").mapInArrow(looked_up, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.where("df > 0").collect()}


def _searcher(items: dict[int, dict[bytes, int]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For shards: each item's k best documents in those of the task; items: each one's terms' weights."""
    terms = sorted(set().union(*items.values())) if items else []
    number = {t: i for i, t in enumerate(terms)}
    wanted = {item: (np.array([number[t] for t in w], np.int64), np.array(list(w.values()), np.int64)) for item, w in items.items() if w}

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # best: scores and document ids so far; ids without a name sort last
        best = {item: [] for item in wanted}
        for batch in batches:
            for row in range(len(batch)):
                shard = {c: batch.column(c)[row] for c in batch.schema.names}
                at = pc.index_in(pa.array(terms, pa.binary()), value_set=shard["terms"].values.cast(pa.binary())).fill_null(-1).to_numpy()
                if (at < 0).all():
                    continue
                starts, ids, named = _numbers(shard["starts"], np.int32), _numbers(shard["docs"], np.int64), _numbers(shard["named"], np.bool_)
                tree = wavelet.Tree.load(shard["bits"].as_py(), _numbers(shard["impacts"], np.int32), wavelet.depth_of(shard["n_docs"].as_py()))
                for item, (which, weights) in wanted.items():
                    here = at[which] >= 0
                    lists = at[which][here]
                    least = best[item][-1][0] * -1 if len(best[item]) == k else 1
                    docs, scores = wavelet.search(tree, starts[lists], starts[lists + 1], weights[here], k, least)
                    more = [(-int(s), not named[d], int(ids[d])) for d, s in zip(docs, scores, strict=True)]
                    best[item] = sorted(best[item] + more)[:k]
        rows = [(item, None if unnamed else doc, -s) for item, found in best.items() for s, unnamed, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["item", "doc_id", "score"])

    return searched


def ranked(docs: DataFrame, items: DataFrame, k: int = K, tokens: int = TOKENS, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    of = corpus(docs)
    shards = index(docs, of, tokens)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary())), pa.array([len(x) for x in found], pa.int64())], names=["item_id", "found", "n"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = in_order(items.select("item_id", utf8(F.col("text")).alias("text")).mapInArrow(split, f"item_id {kind}, found array<binary>, n long"), ["item_id", "n"], sums=["n"])
    numbered = numbered.select("item_id", "found", F.col("place").alias("item"), F.floor(F.col("n_before") / item_terms).alias("part"))
    parts = [r["part"] for r in numbered.select("part").distinct().orderBy("part").collect()]  # a row for each 100,000 terms of items
    out = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    for part in parts:
        asked = {r["item"]: Counter(map(bytes, r["found"])) for r in numbered.where(F.col("part") == part).select("item", "found").collect()}
        df = frequencies(shards, sorted(set().union(*asked.values())))
        weighted = {item: {t: n * of.weight(df[t]) for t, n in found.items() if t in df} for item, found in asked.items()}
        out = out.unionByName(shards.mapInArrow(_searcher(weighted, k), "item long, doc_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).alias("rank")
    best = out.select("item", "doc_id", "score", rank).where(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: ranked(documents, benchmark) in SQL.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM qt) GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
