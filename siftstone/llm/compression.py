"""Quality rules: compression bands.

A text's zstandard ratio (its bytes over its compressed bytes) says how repetitive it is. Each text is measured whole
and in fixed chunks; a repetitive text compresses too well, random or encoded bytes too badly. Short texts compress
worse than long ones of the same kind, so the limits are those of the text's length: lengths are cut into bands of a
quarter octave, and a band's limits lie around the median ratio of all texts of the band that pass the base rules, as far
off as ``REACH`` times the distance of the quartiles, and ``MARGIN`` of the median at least. Chunks have bands of their
own. The margin grows as a band has fewer texts (by ``FEW`` over their number), whose quartiles say less.
Outer limits by length (``WHOLE``, ``CHUNKS``) hold for any table. Copies, told by 64 bits of their content and their
length, count once in the medians, so a group of copies doesn't set them; different texts of one length and ratio count
each, so the limits don't depend on how many texts there are.

A text's chunks are of one size, smaller for texts of below ``CHUNK`` bytes, and what is left after the last full one is
a chunk with the limits of its length (measured with some bytes before it where it is short), so every byte is measured. A text is rejected if its whole ratio is outside its band,
or if over ``MAX_BAD`` of its bytes lie in chunks outside theirs, on whichever side.

Ratios are measured in one pass and written; quantiles come from a histogram of ratio steps (partial counts before the
shuffle, a bounded number of rows), so nothing but the limits, a row a band, is joined to the texts' rows.

Defined cases: a null text is an empty one, has no words and fails the base rules; its ratios are null; very long texts
are measured whole; equal texts get equal verdicts; repeated rows stay; a band of one text is left to the outer limits; an
empty table gives an empty result; other columns of the table aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, utf8, with_fields

LEVEL = 3
CHUNK = 4096
#: Bytes of a chunk for texts of so many bytes or more; a shorter text is one chunk. Of the last chunk at least LEAST are measured (or a full chunk's).
UNITS, LEAST = ((CHUNK, CHUNK), (2048, 1024), (1024, 512), (512, 256)), 512
#: How far from the median a ratio may lie: times the distance of the quartiles, and a share of the median at least, below
#: and above it (names and numbers in prose lower its ratio by more than anything but repetition raises it).
REACH, MARGIN = 4.0, (0.15, 0.08)
#: For bands of few texts the margin is wider by this over their number.
FEW = 20
#: Outer limits: (below so many bytes, least ratio, largest ratio), and those of chunks of CHUNK bytes.
WHOLE = ((256, 0.8, 3.0), (512, 1.05, 3.0), (1024, 1.3, 3.8), (2048, 1.36, 4.4), (4096, 1.4, 5.0), (16384, 1.5, 5.5), (1 << 62, 1.5, 6.5))
CHUNKS = (1.4, 6.0)
#: Steps of the histogram of ratios: so many for each factor of e.
STEPS = 2000
MAX_BAD = 0.25
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(i for i in range(256) if i not in SYMBOLS)
SPACES = b" \t\n\r\x0b\f"
#: Bytes that continue a code point.
CONTINUED = bytes(range(0x80, 0xC0))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    w = np.fromiter((number(x, len(ids)) for x in words), np.int64, len(words))
    v = len(ids)
    if v ** window < 1 << 62:
        key = w[:n].copy()
        for k in range(1, window):
            key = key * v + w[k : n + k]
    else:
        key = np.unique(np.stack([w[k : n + k] for k in range(window)], axis=1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : n + k] |= often
    return int(covered.sum())


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.translate(None, SPACES + CONTINUED))
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    return len(words), chars, len(text.translate(None, NOT_SYMBOLS)), repeated, repeated_words(words)


def unit(n_bytes: int) -> int:
    """Bytes of a chunk of a text."""
    return next((size for at, size in UNITS if n_bytes >= at), max(1, n_bytes))


def ratios(text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float | None, list[float]]:
    """The ratio of the whole text and of each chunk; the last chunk is what is left."""
    if not text:
        return None, []
    size, n = unit(len(text)), len(text)
    whole = n / len(squeeze.compress(text))
    if size == n:
        return whole, [whole]
    parts = [text[i : i + size] for i in range(0, n - size + 1, size)]
    if n % size:
        parts.append(text[-max(min(LEAST, size), n % size) :])
    return whole, [len(x) / len(squeeze.compress(x)) for x in parts]


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, unit long, ratio double, chunks array<double>, h long"


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base counts, n_bytes, unit, ratio, chunks, h) for each row, in one pass without a shuffle."""

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in it:
            rows = []
            for x in batch.column(1):
                body = x.as_py()
                rows.append((*base(body), len(body), unit(len(body)), *ratios(body, squeeze)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [*[pa.int64()] * 7, pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)), batch.column(2)], ["key", *(f.split()[0] for f in COUNTS.split(", "))])

    return docs.select(F.col(key).alias("key"), utf8(F.col(text)).alias("text"), F.xxhash64(utf8(F.col(text))).alias("h")).mapInArrow(batches, with_fields({"key": docs.schema[key].dataType}, COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def length_band(n_bytes: Column) -> Column:
    """Number of the quarter octave that a length is in: its bit length, and the two bits below the highest."""
    bits = F.length(F.bin(n_bytes))
    top = F.conv(F.rpad(F.substring(F.bin(n_bytes), 1, 3), 3, "0"), 2, 10).cast("int")  # 4 to 7
    return 4 * bits + F.pmod(top, F.lit(4))


def _rest() -> Column:
    return F.col("n_bytes") % F.col("unit")


def _rest_measured() -> Column:
    return F.greatest(_rest(), F.least(F.lit(LEAST), F.col("unit")))


def _is_rest(i: Column) -> Column:
    """Whether chunk i is what is left after the last full one."""
    return (i == F.size("chunks") - 1) & (_rest() > 0)


def _step(ratio: Column) -> Column:
    return F.round(F.log(ratio) * STEPS).cast("int")


def limits(rows: DataFrame) -> DataFrame:
    """(chunk, band, low, high): of whole texts and of chunks, by their length's band. rows: measured ones that count."""
    # copies are one
    once = rows.groupBy("h", "n_bytes").agg(F.min("ratio").alias("ratio"), F.min("chunks").alias("chunks"), F.min("unit").alias("unit"))
    whole = F.struct(F.lit(False).alias("chunk"), length_band(F.col("n_bytes")).alias("band"), _step(F.col("ratio")).alias("step"))
    parts = F.transform("chunks", lambda r, i: F.struct(F.lit(True).alias("chunk"), F.when(_is_rest(i), length_band(_rest_measured())).otherwise(length_band(F.col("unit"))).alias("band"), _step(r).alias("step")))
    seen = once.select(F.explode(F.concat(F.array(whole), parts)).alias("of")).groupBy("of.chunk", "of.band", "of.step").count()
    # a row for each step of a band: as many as there are steps between the least and the largest ratio at most
    band = Window.partitionBy("chunk", "band")
    run = F.sum("count").over(band.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = seen.select("chunk", "band", "step", run.alias("upto"), F.sum("count").over(band).alias("n"))
    at = lambda share: F.exp(F.min(F.when(F.col("upto") >= F.col("n") * share, F.col("step"))) / STEPS)
    found = placed.groupBy("chunk", "band").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("n").alias("n"))
    reach = lambda margin: F.greatest(REACH * (F.col("q3") - F.col("q1")), margin * F.col("q2") * (1 + FEW / F.col("n")))
    return found.select("chunk", "band", (F.col("q2") - reach(MARGIN[0])).alias("low"), (F.col("q2") + reach(MARGIN[1])).alias("high"))


def _outer(n_bytes: Column, side: int) -> Column:
    out = F.lit(WHOLE[-1][side])
    for band in reversed(WHOLE[:-1]):
        out = F.when(n_bytes < band[0], band[side]).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, ratios and the verdict for each row."""
    rows = checkpointed(measured(docs, text, key)).withColumn("base_failed", base_failed())
    # bands are quarter octaves of lengths: two hundred rows at most
    bounds = limits(rows.where(~F.col("base_failed")))
    of = lambda chunk, p: F.broadcast(bounds.where(F.col("chunk") == F.lit(chunk)).select(F.col("band").alias(f"{p}_band"), F.col("low").alias(f"{p}_low"), F.col("high").alias(f"{p}_high")))
    n, size, rest = F.col("n_bytes"), F.col("unit"), _rest()
    banded = rows
    for p, chunk, length in (("whole", False, n), ("full", True, size), ("rest", True, _rest_measured())):
        full = (length == CHUNK) & F.lit(chunk)  # the outer limits hold as well
        outer = [F.when(full, CHUNKS[side - 1]).otherwise(_outer(length, side)) for side in (1, 2)]
        banded = banded.withColumn("band", length_band(length)).join(of(chunk, p), F.col("band") == F.col(f"{p}_band"), "left").withColumns({f"{p}_low": F.greatest(f"{p}_low", outer[0]), f"{p}_high": F.least(f"{p}_high", outer[1])}).drop("band")
    bytes_ = lambda i: F.when(_is_rest(i), rest).otherwise(size)
    limit = lambda side, i: F.when(_is_rest(i), F.col(f"rest_{side}")).otherwise(F.col(f"full_{side}"))
    outside = lambda bad: F.aggregate(F.transform("chunks", lambda r, i: F.when(bad(r, i), bytes_(i)).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    banded = banded.withColumns({"high_bytes": outside(lambda r, i: r > limit("high", i)), "low_bytes": outside(lambda r, i: r < limit("low", i))})
    why = F.when(F.col("base_failed"), "base rules").when(F.col("ratio") > F.col("whole_high"), "whole text repetitive").when(F.col("ratio") < F.col("whole_low"), "whole text incompressible")
    why = why.when(F.col("high_bytes") + F.col("low_bytes") > MAX_BAD * n, F.when(F.col("high_bytes") >= F.col("low_bytes"), "chunks repetitive").otherwise("chunks incompressible"))
    judged = banded.withColumn("reason", why)
    return judged.select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), "n_bytes", "ratio", F.array_min("chunks").alias("least_chunk_ratio"), F.array_max("chunks").alias("most_chunk_ratio"), "reason")
