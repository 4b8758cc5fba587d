"""Where a model plugs in: a function of prompts to replies, called in batches on the executors. Nothing here makes a call of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import coerce
from siftstone.operators.verify import confirmer_holds, skeptic_verdict

#: Replies to prompts, of the same number; None where a call failed.
Provider = Callable[[Sequence[str]], Sequence[str | None]]


class Canned:
    """A provider with fixed replies: the first whose mark is in the prompt, else the default."""

    def __init__(self, replies: dict[str, str | None], default: str | None = '{"findings": []}') -> None:
        self.replies, self.default = replies, default

    def __call__(self, prompts: Sequence[str]) -> list[str | None]:
        return [next((r for mark, r in self.replies.items() if mark in p), self.default) for p in prompts]


def ask(rows: DataFrame, provider: Provider, prompt: str = "prompt") -> DataFrame:
    """rows with ``reply`` in place of the prompt; ``ok`` is false where the call failed. A failed call is never an empty reply."""
    rest = [c for c in rows.columns if c != prompt]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            replies = list(provider(part[prompt].tolist()))
            yield part[rest].assign(reply=replies, ok=[r is not None for r in replies])

    schema = rows.select(*rest).schema.add("reply", "string").add("ok", "boolean")
    return rows.select(*rest, prompt).mapInPandas(batches, schema)


def reviewed(units: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(candidates, reviews) of units (unit, pass_no, prompt): the coerced candidates, and each unit's ``ok``: a reply with a list of findings."""
    replies = ask(units.select("unit", "pass_no", "prompt"), provider)
    found = replies.select("unit", "pass_no", "ok", coerce.candidates(F.col("reply")).alias("found"))
    reviews = found.select("unit", "pass_no", (F.col("ok") & F.col("found").isNotNull()).alias("ok"))
    return found.select("unit", "pass_no", F.inline("found")), reviews


def voted(findings: DataFrame, provider: Provider, votes: int = 1) -> DataFrame:
    """(key, vote_no, completed, real, reason) of findings (key, prompt, shown): a skeptic's votes."""
    asked = ask(findings.select("key", "prompt", "shown", F.explode(F.sequence(F.lit(1), F.lit(votes))).alias("vote_no")), provider)
    parsed = asked.withColumn("x", F.from_json("reply", "real boolean, reason string, controls array<string>"))
    known = F.col("ok") & F.coalesce(F.col("x.real").isNotNull() | F.col("x.reason").isNotNull(), F.lit(False))
    real = skeptic_verdict(known, F.col("x.real"), F.col("x.controls"), F.col("shown"))
    return parsed.select("key", "vote_no", real.isNotNull().alias("completed"), F.coalesce(real, F.lit(False)).alias("real"), F.coalesce("x.reason", F.lit("")).alias("reason"))


def confirmed(findings: DataFrame, providers: dict[str, Provider]) -> DataFrame:
    """(key, label, completed, holds) of findings (key, prompt, code), for each labelled confirmer."""
    parts = []
    for label, provider in providers.items():
        asked = ask(findings.select("key", "prompt", "code"), provider).withColumn("x", F.from_json("reply", "holds boolean"))
        holds = confirmer_holds(F.col("x.holds").isNotNull(), F.col("x.holds"), F.col("code"))
        parts.append(asked.select("key", F.lit(label).alias("label"), F.col("ok").alias("completed"), holds.alias("holds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reply_of(findings: list[dict]) -> str:
    return json.dumps({"findings": findings})


class Retrying:
    """A provider that asks again for replies that failed or are blank: a few times, each wait longer and drawn at random.

    deadline: seconds for a call of a batch; one that takes longer has failed, whatever it gives later.
    """

    def __init__(self, provider: Provider, retries: int = 2, wait: float = 1.0, most: float = 60.0, deadline: float | None = None) -> None:
        self.provider, self.retries, self.wait, self.most, self.deadline = provider, retries, wait, most, deadline

    def _call(self, prompts: list[str]) -> Sequence[str | None]:
        if self.deadline is None:
            return self.provider(prompts)
        import threading

        got: list[Sequence[str | None]] = []
        worker = threading.Thread(target=lambda: got.append(self.provider(prompts)), daemon=True)  # left behind if it hangs
        worker.start()
        worker.join(self.deadline)
        return got[0] if got else [None] * len(prompts)

    def __call__(self, prompts: Sequence[str]) -> list[str | None]:
        import random
        import time

        replies: list[str | None] = [None] * len(prompts)
        open_ = list(range(len(prompts)))
        for attempt in range(self.retries + 1):
            try:
                got = self._call([prompts[i] for i in open_])
            except Exception:  # a call that raises is a failed call
                got = [None] * len(open_)
            for i, r in zip(open_, got, strict=True):
                replies[i] = r if r is not None and r.strip() else None
            open_ = [i for i in open_ if replies[i] is None]
            if not open_ or attempt == self.retries:
                break
            time.sleep(random.uniform(0, min(self.most, self.wait * 2**attempt)))
        return replies
