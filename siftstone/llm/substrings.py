"""Suffix-array dedup: removal of every byte that a long string which occurs elsewhere covers.

What recurs in different surroundings is decided by collections' Burrows-Wheeler transforms with common prefixes, built
column by column (``siftstone.llm.bwt``). A round of that construction costs a pass over the collection and there are as
many rounds as symbols in the longest document, so whole documents of any length can't be its documents. Instead:

1. Every string of ``width`` bytes belongs to the class of its minimizer (``siftstone.llm.windows``); runs of strings of
   one class are pieces, below ``2 * width`` bytes. Equal strings are in equal classes, so classes can be decided apart.
2. Classes that occur once are dropped by a count of their keys, which are pre-aggregated; the other pieces are cut from
   the texts and meet by class. A task sends a piece's bytes once, however often it has it.
3. In a class, strings whose hash occurs once are dropped and equal pieces become one with a weight; a piece that shares
   no hash with another one recurs just by its weight. The rest go through the transform: a string recurs if its suffix
   shares ``width`` symbols with a neighbour.

Equal pieces are told by their class (a 64-bit hash of a string in them) and a 64-bit hash of all their bytes, equal
texts by 96 bits; what the transform decides is decided byte by byte.

Classes of over ``hot`` members (a passage that a third of all documents have) are known from the count of their keys.
Their equal pieces are aggregated before the shuffle and get their result by a join, so no task holds all members. If
over ``max_class`` *different* pieces share such a class, its strings become classes of their own, by the string's hash:
up to a hundred rows for a piece, spread over all tasks. So no task decides more than ``hot`` pieces at once. Where no
class is that large, the plan has none of this.

Defined cases: a null text is empty; texts below ``width`` bytes lose nothing; equal texts lose all bytes if they are
long enough; very long texts are read in stretches that overlap; repeated rows count as copies; an empty table gives an
empty result. Extra columns go along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm import bwt, windows
from siftstone.llm.common import checkpointed, col, part, utf8, with_fields

WIDTH, GRAM = 200, 32
#: Texts are hashed in stretches of so many bytes; blocks of classes are decided when they reach this size.
STRETCH, LONGEST, BLOCK = 1 << 18, 1 << 22, 1 << 21
#: Members above which a class's pieces are aggregated first (so many are some 6 MB in a task), and different pieces above which it is split.
HOT, MAX_CLASS = 20_000, 8192

Batches = Iterable[pa.RecordBatch]


def _stretches(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, offset in it, bounds, bytes) of texts put end to end; very long texts are cut, with an overlap."""
    owner: list[int] = []
    offset: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(owner), np.array(offset), np.concatenate([[0], np.cumsum(list(map(len, parts)))]), np.frombuffer(b"".join(parts), dtype=np.uint8)

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), LONGEST):
            part = t if len(t) <= LONGEST else t[at : at + LONGEST + width - 1]
            if len(part) < width:
                continue
            owner.append(i)
            offset.append(at)
            parts.append(part)
            size += len(part)
            if size >= STRETCH:
                yield flush()
                owner, offset, parts, size = [], [], [], 0
    if parts:
        yield flush()


def class_keys(width: int, gram: int):
    """Rows (key, h, at) of the pieces of (h, text); at: start in the text, times 2**16, plus the number of strings."""

    def read(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            for owner, offset, bounds, data in _stretches(batch.column(1).to_pylist(), width):
                text, key, start, n = windows.pieces(data, bounds, width, gram)
                at = (start - bounds[text] + offset[text]) << 16 | n
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h[owner[text]]), pa.array(at)], ["key", "h", "at"])

    return read


def cut(width: int):
    """Rows (key, d, h, c, at, piece) of rows (id, h, c, text, found: its pieces); the bytes come with a task's first one of a kind."""

    def read(batches: Batches) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found = batch.column(4)
            keys, ats = (found.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("key", "at"))
            ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))
            h, c = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = 0
            for i, (text, end) in enumerate(zip(batch.column(3), ends.tolist(), strict=True)):
                text, key, at = text.as_py(), keys[first:end], ats[first:end]
                first = end
                low = at >> 16
                high = low + (at & 0xFFFF) + width - 1
                own = high <= len(text)  # else another text's, of equal hash
                key, at = key[own], at[own]
                parts = [text[x:y] for x, y in zip(low[own].tolist(), high[own].tolist(), strict=True)]
                d = [digest(x) - (1 << 63) for x in parts]
                for j, kind in enumerate(zip(key.tolist(), d, strict=True)):
                    if kind in sent:
                        parts[j] = None
                    else:
                        sent.add(kind)
                if len(sent) > 1 << 18:
                    sent.clear()
                if len(key):
                    columns = (key, np.array(d, dtype=np.int64), np.full(len(key), h[i]), np.full(len(key), c[i]), at)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], ["key", "d", "h", "c", "at", "piece"])

    return read


def recurring(pieces: list[bytes], weights: np.ndarray, width: int) -> list[np.ndarray]:
    """For each of different pieces (each there weight times): which of its strings recur."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = [np.zeros(n - width + 1, dtype=bool) for n in lengths.tolist()]
    if len(data) < width:
        return out
    owner = np.repeat(np.arange(len(pieces)), lengths)[: len(data) - width + 1]
    inside = np.arange(len(owner)) + width <= bounds[owner + 1]
    hashes, place, owner = windows.string_hashes(data, width)[inside], np.flatnonzero(inside), owner[inside]
    _, number = np.unique(hashes, return_inverse=True)
    number = number.ravel()
    maybe = np.bincount(number, weights=weights[owner])[number] > 1.5
    if not maybe.any():
        return out
    # runs of strings that may recur, equal ones as one
    edge = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8)))
    run_from, run_to = edge[::2], edge[1::2]
    # a run ends with its piece
    cuts = np.flatnonzero(np.diff(owner)) + 1
    starts = np.unique(np.concatenate([run_from, cuts[maybe[cuts]]]))
    ends = np.minimum(run_to[np.searchsorted(run_to, starts, side="right")], np.append(cuts, len(owner))[np.searchsorted(cuts, starts, side="right")])
    kinds: dict[bytes, int] = {}
    kind = np.fromiter((kinds.setdefault(data[place[a] : place[b - 1] + width].tobytes(), len(kinds)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
    total = np.bincount(kind, weights=weights[owner[starts]]).astype(np.int64)
    one = np.zeros(len(kinds), dtype=np.int64)
    one[kind[::-1]] = np.arange(len(starts))[::-1]
    which = np.repeat(np.arange(len(kinds)), ends[one] - starts[one])
    of_kind = np.concatenate([number[starts[k] : ends[k]] for k in one.tolist()])
    shares = np.bincount(of_kind)[of_kind] > 1
    meets = np.bincount(which, weights=shares, minlength=len(kinds)) > 0
    texts = list(kinds)
    flags: dict[int, np.ndarray] = {}
    chosen = np.flatnonzero(meets).tolist()
    if chosen:
        flags = dict(zip(chosen, bwt.repeated_starts([texts[i] for i in chosen], total[chosen], width), strict=True))
    for a, b, k in zip(starts.tolist(), ends.tolist(), kind.tolist(), strict=True):
        i = owner[a]
        at = place[a] - bounds[i]
        out[i][at : at + b - a] = flags.get(k, total[k] > 1)
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _blocks(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The rows (sorted by key, in column 0) in blocks of whole classes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        first = held and held[-1].column(0)[-1].as_py() == keys[0]
        if size + batch.nbytes < BLOCK or first and last == 0:
            held.append(batch)
            size += batch.nbytes
            continue
        # what precedes the batch's last class is whole; the batch may be far larger than a block
        at = 0
        while at < last:
            step = max(1, int(batch.num_rows * BLOCK / max(1, batch.nbytes)))
            to = int(np.searchsorted(keys, keys[min(at + step, last) - 1], side="right")) if at + step < last else last
            held.append(batch.slice(at, to - at))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, at = [], to
        if last == 0 and held:  # the batch is of one class, another than what is held
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
        size = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _decided(key: np.ndarray, d: np.ndarray, weight: np.ndarray, text: pa.Array, width: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For rows of whole classes: the number of each row's piece, and each piece's runs of recurring strings."""
    order = np.lexsort((d, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (d[order][1:] != d[order][:-1])])
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    there = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
    first = np.full(int(number.max()) + 1, -1)
    first[number[there][::-1]] = there[::-1]
    if (first < 0).any():
        raise RuntimeError("a piece came without its bytes")
    pieces = text.take(pa.array(first)).to_pylist()
    total = np.bincount(number, weights=weight).astype(np.int64)
    # a class of one piece needs no look at its strings
    kind_key = key[first]
    size = np.unique(kind_key, return_inverse=True)
    alone = np.bincount(size[1].ravel())[size[1].ravel()] == 1
    runs: list[list[tuple[int, int]]] = [[(0, len(p) - width + 1)] if w > 1 else [] for p, w in zip(pieces, total.tolist(), strict=True)]
    many = np.flatnonzero(~alone)
    for i, f in zip(many.tolist(), recurring([pieces[i] for i in many], total[many], width) if len(many) else [], strict=True):
        runs[i] = _runs(f)
    return number, runs


def decide_members(width: int):
    """(h, c, low, high) of what recurs, from rows (key, d, h, c, at, piece) sorted by key; a row is one piece of one text."""

    def read(batches: Batches) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            key, d, h, c, at = (block.column(i).to_numpy() for i in range(5))
            number, runs = _decided(key, d, np.ones(len(key)), block.column(5), width)
            rows = [(i, (a >> 16) + x, (a >> 16) + y + width - 1) for i, (a, k) in enumerate(zip(at.tolist(), number.tolist(), strict=True)) for x, y in runs[k]]
            if rows:
                i, low, high = (np.array(v, dtype=np.int64) for v in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (h[i], c[i], low, high)], ["h", "c", "low", "high"])

    return read


def decide_kinds(width: int):
    """(key, d, x, y): runs of recurring strings of rows (key, d, weight, piece) sorted by key; a row is one kind of piece."""

    def read(batches: Batches) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            key, d, weight = (block.column(i).to_numpy() for i in range(3))
            number, runs = _decided(key, d, weight, block.column(3), width)
            rows = [(k, e, x, y) for k, e, i in zip(key.tolist(), d.tolist(), number.tolist(), strict=True) for x, y in runs[i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], ["key", "d", "x", "y"])

    return read


def _strings(width: int, with_text: bool):
    """Rows (key, d, x, wkey[, wd, weight, piece]): the single strings of pieces, with their hashes."""

    def read(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ds, ws, texts = (batch.column(i).to_pylist() for i in range(4))
            chosen = batch.column(4).to_pylist() if with_text else [None] * len(keys)
            for k, d, w, t, xs in zip(keys, ds, ws, texts, chosen, strict=True):
                hashes = windows.string_hashes(np.frombuffer(t, dtype=np.uint8), width).view(np.int64)
                x = np.arange(len(hashes)) if xs is None else np.unique(np.array(xs))
                columns = [pa.array(np.full(len(x), k)), pa.array(np.full(len(x), d)), pa.array(x), pa.array(hashes[x])]
                names = ["key", "d", "x", "wkey"]
                if with_text:
                    parts = [t[i : i + width] for i in x.tolist()]
                    columns += [pa.array([xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts], pa.int64()), pa.array(np.full(len(x), w)), pa.array(parts, pa.binary())]
                    names += ["wd", "weight", "piece"]
                else:
                    columns.append(pa.array(np.full(len(x), w)))
                    names.append("weight")
                yield pa.RecordBatch.from_arrays(columns, names)

    return read


KINDS_DDL = "key long, d long, x long, y long"


def _by_string(kinds: DataFrame, width: int) -> DataFrame:
    """decide_kinds for classes with too many different pieces: each string is a class by its own hash."""
    strings = kinds.mapInArrow(_strings(width, False), "key long, d long, x long, wkey long, weight long")
    often = strings.groupBy("wkey").agg(F.sum("weight").alias("n")).where("n > 1").select("wkey")
    left = strings.join(often, "wkey", "left_semi").groupBy("key", "d").agg(F.collect_list("x").alias("xs"))
    single = kinds.join(left, ["key", "d"]).select("key", "d", "weight", "piece", "xs").mapInArrow(_strings(width, True), "key long, d long, x long, wkey long, wd long, weight long, piece binary")
    classes = single.groupBy("wkey", "wd").agg(F.sum("weight").alias("weight"), F.first("piece").alias("piece")).repartition("wkey").sortWithinPartitions("wkey")
    found = classes.mapInArrow(decide_kinds(width), KINDS_DDL).select(F.col("key").alias("wkey"), F.col("d").alias("wd")).distinct()
    return single.select("key", "d", "x", "wkey", "wd").join(found, ["wkey", "wd"]).select("key", "d", "x", (F.col("x") + 1).alias("y"))


def recurring_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, max_class: int = MAX_CLASS) -> DataFrame:
    """(id, text, ranges): the byte ranges covered by recurring strings, null if none. docs has id, text (bytes), h and c (hashes of the text)."""
    pieces = docs.select("h", "text").mapInArrow(class_keys(width, gram), "key long, h long, at long")
    counts = checkpointed(pieces.groupBy("key", part(F.col("key"))).count().where("count > 1").select("key", (F.col("count") > hot).alias("hot")))
    any_hot = not counts.where("hot").isEmpty()
    by_text = pieces.join(counts, "key").groupBy("h", part(F.col("h"))).agg(F.collect_set(F.struct("key", "at", "hot")).alias("found"))
    held = docs.join(by_text.select(F.col("h").alias("of"), "found"), F.col("h") == F.col("of"))

    def cuts(of: Column) -> DataFrame:
        found = F.transform(F.filter("found", lambda x: of == x["hot"]), lambda x: F.struct(x["key"].alias("key"), x["at"].alias("at")))
        some = held.select("id", "h", "c", "text", found.alias("found")).where(F.size("found") > 0)
        return some.mapInArrow(cut(width), "key long, d long, h long, c long, at long, piece binary")

    rows = cuts(F.lit(False)).repartition("key").sortWithinPartitions("key").mapInArrow(decide_members(width), "h long, c long, low long, high long")
    if any_hot:
        rows = rows.unionByName(_of_hot(cuts(F.lit(True)), width, max_class))
    by_content = rows.groupBy("h", "c").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    # by h alone, so that the texts' exchange is the one that they met their pieces by
    by_hash = by_content.groupBy("h", part(F.col("h"))).agg(F.collect_list(F.struct("c", "ranges")).alias("by_c")).select(F.col("h").alias("of"), "by_c")
    own = F.get(F.filter("by_c", lambda x: x["c"] == F.col("c")), F.lit(0))["ranges"]
    return docs.join(by_hash, F.col("h") == F.col("of"), "left").select("id", "text", own.alias("ranges"))


def _of_hot(warm: DataFrame, width: int, max_class: int) -> DataFrame:
    """(h, c, low, high) of what recurs in hot classes, from cut pieces: equal ones are one before they meet."""
    kinds = warm.groupBy("key", "d").agg(F.count("*").alias("weight"), F.first("piece", ignorenulls=True).alias("piece"))
    # the piece is read, so that all uses of kinds share one exchange
    large = kinds.where(F.length("piece") > 0).groupBy("key").count().where(F.col("count") > max_class).select("key")
    small = kinds.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key").select("key", "d", "weight", "piece")
    found = small.mapInArrow(decide_kinds(width), KINDS_DDL).unionByName(_by_string(kinds.join(large, "key", "left_semi"), width))
    found = found.groupBy("key", "d", part(F.col("key"), F.col("d"))).agg(F.collect_list(F.struct("x", "y")).alias("runs"))
    start = F.shiftright("at", 16)
    return warm.select("key", "d", "h", "c", "at").join(found.drop("_part"), ["key", "d"]).select("h", "c", start.alias("start"), F.explode("runs").alias("run")).select("h", "c", (F.col("start") + F.col("run.x")).alias("low"), (F.col("start") + F.col("run.y") + width - 1).alias("high"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        if out and low <= out[-1][1]:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def kept_bytes(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    if not ranges:
        return text
    return b"".join([text[a:b] for a, b in zip([0, *(r[1] for r in ranges)], [*(r[0] for r in ranges), len(text)], strict=True)])


def _with_hashes(docs: DataFrame, key: Column, text: str) -> DataFrame:
    """id, text, h and c: rows for recurring_ranges."""
    body = utf8(F.col(text))
    return docs.select(key.alias("id"), body.alias("text"), F.xxhash64(body).alias("h"), F.crc32(body).alias("c"))


def removal_digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, max_class: int = MAX_CLASS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""

    def digest(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, found = text.as_py(), merged(found)
                kept = kept_bytes(text, found)
                n.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(len(found))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ranges = recurring_ranges(_with_hashes(docs, F.col("doc_id"), "text"), width, gram, hot, max_class)
    return ranges.mapInArrow(digest, with_fields({"doc_id": docs.schema["doc_id"].dataType}, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_recurring(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with recurring byte ranges cut out of the text column (what is left of a cut character is dropped); a null text stays null."""
    names = docs.columns
    # the given columns but the text go through as one, so that none of their names can clash
    rest = [col(n).alias(n) for n in names if n != text]
    row = F.struct(F.struct(*rest).alias("given") if rest else F.lit(None).alias("given"), col(text).isNull().alias("without"))
    ranges = recurring_ranges(_with_hashes(docs, row, text), width)

    def clean(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kept_bytes(t, merged(r)).decode("utf-8", "ignore") for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "left"])

    cleaned = ranges.mapInArrow(clean, with_fields({"row": ranges.schema["id"].dataType}, "left string"))
    return cleaned.select(*(F.when(~F.col("row.without"), F.col("left")).alias(n) if n == text else F.col("row.given")[n].alias(n) for n in names))


#: removal_digests(documents) in SQL, by counting every string of 200 bytes, in hexadecimal.
ORACLE_SQL = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, substr(x, 2 * i + 1, 400) AS s FROM (SELECT r, x, unnest(range(0, greatest(0, length(x) // 2 - 199))) AS i FROM b)),
o AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT r, i FROM w SEMI JOIN o ON w.s = o.s),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM m),
n AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
q AS (SELECT r, k, min(i) AS low, max(i) + 200 AS high FROM n GROUP BY r, k),
p AS (SELECT r, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM q GROUP BY r),
t AS (SELECT doc_id, x, coalesce(len(lows), 0) AS spans, coalesce(list_sum(highs) - list_sum(lows), 0) AS gone,
CASE WHEN lows IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(lows) + 1), lambda j: substr(x, 2 * coalesce(highs[j], 0) + 1, 2 * (coalesce(lows[j + 1], length(x) // 2) - coalesce(highs[j], 0)))), '') END AS kept FROM b LEFT JOIN p USING (r))
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t
"""
