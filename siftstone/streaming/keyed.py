"""The union of candidates as keyed state: what is known of a key is updated by its new rows alone.

A key's state is its first row, a count of votes for each severity, whether any row confirmed it, the models that found
it and its different evidence texts with the least seq of each. Rows may come in any order and in any batch; the state
after them is what a fold over all of them gives. State is kept by the state store (RocksDB), so a restart goes on where
it stopped, and with ``ttl`` a key that had no row for so long is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftstone.functions import severity
from siftstone.operators import union

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FIELDS = "title string, category string, endpoint string, symbol string, file string, line int, source string"
HEAD = f"seq long, {_FIELDS}, status string, found_by array<string>"
VOTES = "critical long, high long, medium long, low long, confirmed boolean"
OUT = f"key string, seq long, {_FIELDS}, severity string, evidence string, status string, found_by array<string>, n_rows long"


def folded_evidence(texts: list[tuple[int, str]]) -> str:
    """Evidence by seq, parted by ``; ``; one that the text so far contains is left out."""
    out = ""
    for _, text in sorted(texts):
        if text not in out:
            out = f"{out}; {text}" if out else text
    return out


class UnionState(StatefulProcessor):
    """Rows with key and level (0 for CRITICAL to 3 for LOW) in, the key's union out."""

    def __init__(self, ttl: int | None = None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD, self.ttl)
        self.votes = handle.getValueState("votes", VOTES, self.ttl)
        self.models = handle.getMapState("models", "model string", "seen boolean", self.ttl)
        self.evidence = handle.getMapState("evidence", "text string", "seq long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        head, votes = self.head.get(), list(self.votes.get() or (0, 0, 0, 0, False))
        for r in rows:
            votes[r["level"]] += 1
            votes[4] = votes[4] or r["status"] == union.CONFIRMED
            if head is None or r["seq"] < head[0]:
                head = (r["seq"], *(r[c] for c in union.FIRST), r["status"], r["found_by"])
            for model in r["found_by"] or ():
                if model is not None and not self.models.containsKey((model,)):
                    self.models.updateValue((model,), (True,))
            text = r["evidence"]
            if text:
                known = self.evidence.getValue((text,)) if self.evidence.containsKey((text,)) else None
                if known is None or r["seq"] < known[0]:
                    self.evidence.updateValue((text,), (r["seq"],))
        self.head.update(tuple(head))
        self.votes.update(tuple(votes))
        n = sum(votes[:4])
        texts = [(seq, text) for (text,), (seq,) in self.evidence.iterator()]
        models = list(head[-1]) if n == 1 and head[-1] is not None else None if n == 1 else sorted(m for (m,) in self.models.keys())
        yield Row(key=key[0], seq=head[0], **dict(zip(union.FIRST, head[1:-2], strict=True)), severity=severity.middle(votes[:4]), evidence=folded_evidence(texts), status=union.CONFIRMED if votes[4] else head[-2], found_by=models, n_rows=n)

    def close(self) -> None:
        pass


def running_union(candidates: DataFrame, by_file: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the union's rows: each batch gives the new state of the keys that it has rows of.

    n_rows only grows, so of several rows of a key the one with the most is the latest (``latest``).
    """
    candidates.sparkSession.conf.set(STORE, ROCKSDB)
    level = severity.index(severity.normalize(F.col("severity"))).alias("level")
    rows = candidates.select(union.candidate_key(by_file).alias("key"), F.col("seq").cast("long").alias("seq"), *union.FIRST, "status", "evidence", "found_by", level)
    return rows.groupBy("key").transformWithState(statefulProcessor=UnionState(ttl_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def latest(updates: DataFrame) -> DataFrame:
    """Of rows of a running union that were kept, the last of each key."""
    return updates.groupBy("key").agg(F.max_by(F.struct(*(c for c in updates.columns if c != "key")), "n_rows").alias("x")).select("key", "x.*")


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The union of what a running union has written below a path."""
    return latest(spark.read.parquet(path))
