"""Media columns: GIF files in binary columns, read as timed frames with colour-histogram columns.

``decode_gif`` reads any GIF87a/89a stream: LZW codes of 2 to 8 bits (deferred clear codes too), global and
local palettes, interlacing, transparency and the disposal rules. ``encode_gif`` writes frames with real LZW
compression. Both work on one value at a time, inside Arrow batches, so a job has no shuffle and holds one
document's media at once.

Defined cases: a null or empty text is stored as 64 zero bytes; a null GIF has no frames; a broken one raises
``ValueError`` (``frames`` has ``on_error="skip"`` to give one row with the error instead). Equal bytes give
equal results, so repeated rows agree. A very long text is stored whole, in as many frames as it takes; an empty
table gives an empty result. Extra columns of the input, whatever their names, are neither read nor carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import utf8

MAX_BITS = 12
TABLE_SIZE = 1 << MAX_BITS
#: Payloads are stored in frames of this width and at most so many rows.
WIDTH, FRAME_ROWS, DELAY_CS = 64, 1024, 10
#: Histogram bins: 2 bits of red, green and blue each.
N_BINS = 64


@dataclass
class Frame:
    """One image of a stream: palette indices as stored, its place, timing and rules; ``canvas`` is RGBA as shown."""

    indices: np.ndarray
    palette: np.ndarray
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    canvas: np.ndarray | None = None


# ---- LZW


@cache
def _widths(min_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of code 0, 1, ... after a clear code, their offsets and masks: the reader's table lags one entry behind the writer's."""
    free = (1 << min_bits) + 2 + np.maximum(np.arange(TABLE_SIZE + 2) - 1, 0)
    widths = np.minimum(MAX_BITS, np.maximum(min_bits + 1, np.floor(np.log2(free)).astype(np.int64) + 1))
    return widths, np.concatenate([[0], np.cumsum(widths)]), (1 << widths) - 1


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """GIF's LZW code stream of the symbols in data, starting with a clear code; the table restarts when full."""
    clear, first = 1 << min_bits, (1 << min_bits) + 2
    runs: list[list[int]] = []
    if data:
        out: list[int] = []
        table: dict[int, int] = {}
        emit, get, free = out.append, table.get, first
        symbols = iter(data)
        prefix = next(symbols)
        for c in symbols:
            key = prefix << 8 | c
            known = get(key)
            if known is not None:
                prefix = known
                continue
            emit(prefix)
            if free < TABLE_SIZE:
                table[key] = free
                free += 1
            else:
                emit(clear)
                runs.append(out)
                out, table, free = [], {}, first
                emit, get = out.append, table.get
            prefix = c
        emit(prefix)
        runs.append(out)
    else:
        runs.append([])
    runs[-1].append(clear + 1)
    by_place = _widths(min_bits)[0]
    codes = np.concatenate([np.array([clear]), *(np.array(r, dtype=np.int64) for r in runs)])
    widths = np.concatenate([by_place[:1], *(by_place[: len(r)] for r in runs)])
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted, at, size = codes << (starts & 7), starts >> 3, (int(ends[-1]) + 7) // 8
    packed = np.zeros(size + 3)
    for k in range(3):
        packed += np.bincount(at + k, weights=(shifted >> 8 * k) & 255, minlength=size + 3)[: size + 3]
    return packed[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int) -> bytes:
    """The symbols of a GIF LZW code stream. Codes between two clears are cut out at once; their strings are then joined."""
    clear, end, first = 1 << min_bits, (1 << min_bits) + 1, (1 << min_bits) + 2
    raw = np.frombuffer(stream + bytes(4), dtype=np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = len(stream) * 8
    widths, offsets, masks = _widths(min_bits)
    literals = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    emit = out.append
    position, table, previous, free, seen = 0, list(literals), b"", first, 0
    while position < total:
        if seen < TABLE_SIZE:
            n = int(np.searchsorted(offsets[seen:], offsets[seen] + total - position, side="right")) - 1
            n = min(n, len(widths) - seen)
            places, mask = position + offsets[seen : seen + n] - offsets[seen], masks[seen : seen + n]
            steps = offsets[seen : seen + n + 1] - offsets[seen]
        else:  # the table is full and no clear code came: 12 bits each
            n = min((total - position) // MAX_BITS, TABLE_SIZE)
            places, mask = position + np.arange(n) * MAX_BITS, TABLE_SIZE - 1
            steps = np.arange(n + 1) * MAX_BITS
        if n <= 0:
            break
        codes = (words[places >> 3] >> (places & 7).astype(np.uint32)) & mask
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        append = table.append
        for code in codes[:stop].tolist():
            if previous:
                if code < free:
                    string = table[code]
                elif code == free:
                    string = previous + previous[:1]
                else:
                    raise ValueError("a code points beyond the table")
                if free < TABLE_SIZE:
                    append(previous + string[:1])
                    free += 1
            elif code < clear:
                string = table[code]
            else:
                raise ValueError("the first code is no literal")
            emit(string)
            previous = string
        seen += stop
        position += int(steps[stop])
        if stop < n:
            position += int(widths[min(seen, len(widths) - 1)])
            if codes[stop] == end:
                break
            table, previous, free, seen = list(literals), b"", first, 0
    return b"".join(out)


# ---- files


def _sub_blocks(data: bytes) -> bytes:
    full, rest = divmod(len(data), 255)
    head = np.empty((full, 256), dtype=np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=full * 255).reshape(full, 255)
    return head.tobytes() + (bytes((rest,)) + data[-rest:] if rest else b"") + b"\0"


def encode_gif(frames: list[Frame], width: int, height: int, palette: np.ndarray) -> bytes:
    """A GIF89a file. A frame whose palette is not the global one gets it as a local one."""
    bits = max(1, int(len(palette) - 1).bit_length())
    full = np.zeros((1 << bits, 3), dtype=np.uint8)
    full[: len(palette)] = palette
    parts = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | (bits - 1), 0, 0) + full.tobytes()]
    for f in frames:
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0) + b"\0")
        own, local = b"", 0
        depth = bits
        if f.palette is not palette:
            depth = max(1, int(len(f.palette) - 1).bit_length())
            table = np.zeros((1 << depth, 3), dtype=np.uint8)
            table[: len(f.palette)] = f.palette
            own, local = table.tobytes(), 0x80 | (depth - 1)
        rows, columns = f.indices.shape
        parts += [b"\x2c" + struct.pack("<HHHHB", f.left, f.top, columns, rows, local) + own, bytes((max(2, depth),))]
        parts.append(_sub_blocks(lzw_encode(np.ascontiguousarray(f.indices).tobytes(), max(2, depth))))
    return b"".join(parts) + b"\x3b"


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order, each with the canvas as a viewer shows it."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += size + 1
        return b"".join(parts), at + 1

    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                rule, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = rule >> 2 & 7, index if rule & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, columns, rows, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("a frame has no palette")
        min_bits = data[at]
        body, at = blocks(at + 1)
        symbols = lzw_decode(body, min_bits)
        if len(symbols) < rows * columns:
            raise ValueError("a frame has too few pixels")
        indices = np.frombuffer(symbols, dtype=np.uint8, count=rows * columns).reshape(rows, columns)
        if local & 0x40:
            straight = np.empty_like(indices)
            straight[_interlaced(rows)] = indices
            indices = straight
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[: len(palette), :3] = palette
        colours[:, 3] = 255
        before = canvas.copy() if disposal == 3 else None
        # what lies outside the canvas isn't shown
        seen = indices[: max(0, height - top), : max(0, width - left)]
        part = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        if transparent is None:
            part[...] = colours[seen]
        else:
            solid = seen != transparent
            part[solid] = colours[seen[solid]]
        yield Frame(indices, palette, left, top, delay, disposal, transparent, canvas.copy())
        if disposal == 2:
            part[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by the top two bits of red, green and blue; see-through ones aren't counted."""
    bins = (canvas[..., 0] >> 6 << 4) | (canvas[..., 1] >> 6 << 2) | (canvas[..., 2] >> 6)
    return np.bincount(bins[canvas[..., 3] > 0], minlength=N_BINS)


# ---- columns

FRAMES = pa.schema([(n, t) for n, t in (("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string()))])
FRAMES_DDL = "id long, frame int, start_ms long, delay_ms long, disposal int, left int, top int, width int, height int, rgba binary, histogram array<long>, error string"


def frames(df: DataFrame, gif: str, key: str, on_error: str = "raise") -> DataFrame:
    """A row for each frame of the column's files: its time, place, the canvas shown (RGBA, row by row) and its histogram."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                rows, start = [], 0
                try:
                    for i, f in enumerate(decode_gif(data)):
                        rows.append((k, i, start, 10 * f.delay_cs, f.disposal, f.left, f.top, f.indices.shape[1], f.indices.shape[0], f.canvas.tobytes(), colour_histogram(f.canvas).tolist(), None))
                        start += 10 * f.delay_cs
                except ValueError as e:
                    if on_error == "raise":
                        raise
                    rows.append((k, *[None] * 10, str(e)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(FRAMES.names, r, strict=True)) for r in rows], schema=FRAMES)

    return df.select(F.col(key).cast("long"), F.col(gif)).mapInArrow(read, FRAMES_DDL)


def byte_palette() -> np.ndarray:
    """256 colours: three bits of red and green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


PALETTE = byte_palette()


def store_payload(text: bytes) -> bytes:
    """The GIF that holds the bytes, padded with zeros to a positive multiple of 64, as pixels; long ones in several frames, each shown alone."""
    rows = max(1, -(-len(text) // WIDTH))
    pixels = np.frombuffer(text.ljust(rows * WIDTH, b"\0"), dtype=np.uint8).reshape(rows, WIDTH)
    parts = [Frame(pixels[i : i + FRAME_ROWS], PALETTE, delay_cs=DELAY_CS, disposal=2) for i in range(0, rows, FRAME_ROWS)]
    return encode_gif(parts, WIDTH, min(rows, FRAME_ROWS), PALETTE)


def read_payload(gif: bytes) -> tuple[bytes, str]:
    """The pixels of all frames in order, and a feature: frames, duration and summed histogram."""
    parts, total, n, ms = [], np.zeros(N_BINS, dtype=np.int64), 0, 0
    for f in decode_gif(gif):
        parts.append(f.indices.tobytes())
        total += colour_histogram(f.canvas)
        n, ms = n + 1, ms + 10 * f.delay_cs
    return b"".join(parts), f"frames={n};ms={ms};hist=" + ",".join(map(str, total.tolist()))


STORED_DDL = "doc_id long, n_bytes long, gif binary"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, unpadded size and the GIF of each document's text."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([store_payload(text)], pa.binary())], ["doc_id", "n_bytes", "gif"])

    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text")).mapInArrow(store, STORED_DDL)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each document stored as a GIF, read back from the stored bytes and digested, in one pass without a shuffle."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                gif = store_payload(text)
                payload, feature = read_payload(gif)
                rows.append((k, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), feature))
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r, strict=True)) for r in rows], schema=DIGEST)

    return docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("text")).mapInArrow(digest, DIGEST_DDL)
