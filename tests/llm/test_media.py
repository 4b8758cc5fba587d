import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from siftstone.llm import gif

DOCS = "doc_id long, text string, size int, gif string"


@pytest.mark.parametrize("min_bits", range(2, 9))
def test_lzw_round_trip(min_bits):
    rng = random.Random(min_bits)
    for n in (0, 1, 2, 300, 30_000):
        data = bytes(rng.randrange(1 << min_bits) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, min_bits), min_bits) == data
        same = bytes(n)
        assert gif.lzw_decode(gif.lzw_encode(same, min_bits), min_bits) == same


def codes_to_stream(codes, min_bits):
    """A plain bit packer with the reader's width rule, kept apart from the code under test."""
    width, free, out, bits, n = min_bits + 1, (1 << min_bits) + 2, bytearray(), 0, 0
    first = True
    for c in codes:
        bits |= c << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8
        if c == 1 << min_bits:
            width, free, first = min_bits + 1, (1 << min_bits) + 2, True
        elif first:
            first = False
        elif free < 4096:
            free += 1
            if free == 1 << width and width < 12:
                width += 1
    if n:
        out.append(bits & 255)
    return bytes(out)


def test_lzw_reads_streams_that_clear_late_or_often():
    literals = [random.Random(1).randrange(256) for _ in range(9000)]
    late = [256, *literals, 257]  # the table is full, no clear code comes
    assert gif.lzw_decode(codes_to_stream(late, 8), 8) == bytes(literals)
    often = [256]
    for i in range(0, 9000, 100):
        often += [*literals[i : i + 100], 256]
    assert gif.lzw_decode(codes_to_stream([*often, 257], 8), 8) == bytes(literals)
    # a code that isn't in the table yet: aaa
    assert gif.lzw_decode(codes_to_stream([256, 97, 258, 257], 8), 8) == b"aaa"
    with pytest.raises(ValueError):
        gif.lzw_decode(codes_to_stream([256, 97, 400, 257], 8), 8)


def animation():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], dtype=np.uint8)
    full = lambda v: np.full((2, 2), v, dtype=np.uint8)
    one = np.array([[2]], dtype=np.uint8)
    frames = [gif.Frame(full(1), palette, delay_cs=5, disposal=1), gif.Frame(one, palette, left=1, top=1, delay_cs=7, disposal=2), gif.Frame(np.array([[3, 0]], dtype=np.uint8), palette, top=0, delay_cs=1, disposal=3, transparent=0), gif.Frame(one, palette, left=0, top=0, disposal=1)]
    return gif.encode_gif(frames, 2, 2, palette)


def test_disposal_and_transparency():
    shown = [f.canvas.tolist() for f in gif.decode_gif(animation())]
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown[0] == [[red, red], [red, red]]
    assert shown[1] == [[red, red], [red, green]]
    assert shown[2] == [[blue, red], [red, clear]]  # the frame before was cleared, this one's pixel 0 is see-through
    assert shown[3] == [[green, red], [red, clear]]  # and this one starts from what was there before the third


def test_local_palettes_and_interlacing():
    own = np.array([[9, 9, 9], [8, 8, 8]], dtype=np.uint8)
    pixels = np.arange(20, dtype=np.uint8).reshape(20, 1) % 2
    data = bytearray(gif.encode_gif([gif.Frame(pixels[gif._interlaced(20)], own)], 1, 20, gif.PALETTE))
    at = data.index(b"\x2c", 13 + 768)
    data[at + 9] |= 0x40
    frame = next(gif.decode_gif(bytes(data)))
    assert frame.indices.ravel().tolist() == pixels.ravel().tolist()
    assert frame.canvas[1, 0].tolist() == [8, 8, 8, 255]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 70_000, 200_000])
def test_payloads_come_back(n):
    text = os.urandom(n)
    stored, feature = gif.read_payload(gif.store_payload(text))
    assert stored == text.ljust(max(64, -(-n // 64) * 64), b"\0")
    assert sum(map(int, feature.split("hist=")[1].split(","))) == len(stored)


def test_frames_table(spark):
    df = spark.createDataFrame([(1, bytearray(animation())), (2, None), (3, bytearray(b"no gif"))], "k long, g binary")
    rows = gif.frames(df, "g", "k", on_error="skip").orderBy("id", "frame").collect()
    assert [(r["id"], r["start_ms"], r["delay_ms"]) for r in rows] == [(1, 0, 50), (1, 50, 70), (1, 120, 10), (1, 130, 0), (3, None, None)]
    assert sum(rows[0]["histogram"]) == 4 and rows[4]["error"]
    with pytest.raises(Exception, match="signature"):
        gif.frames(df, "g", "k").count()
    stored = gif.store_documents(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert gif.frames(stored, "gif", "doc_id").count() == 2


def test_digests_of_odd_documents(spark):
    long = "é\n" * 100_000
    texts = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, long), (None, "x"), (1, "abc")]
    rows = gif.media_digests(spark.createDataFrame([(*t, 0, "") for t in texts], DOCS)).collect()
    assert len(rows) == len(texts)
    for (_, text), r in zip(texts, rows, strict=True):
        body = (text or "").encode()
        padded = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[0][1:] == rows[1][1:] == rows[6][1:]
    assert gif.media_digests(spark.createDataFrame([], DOCS)).count() == 0


def plain_lzw(stream, min_bits, n):
    """The first n symbols, a bit and a code at a time, by the format's description."""
    bits = [b >> k & 1 for b in stream for k in range(8)]
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    table, width, at, last, out = {}, min_bits + 1, 0, None, []
    while len(out) < n:
        code = sum(b << k for k, b in enumerate(bits[at : at + width]))
        at += width
        if code == clear:
            table, width, last = {i: (i,) for i in range(clear)} | {clear: (), end: ()}, min_bits + 1, None
            continue
        if code == end:
            break
        said = table[code] if code in table else (*last, last[0])
        out += said
        if last is not None and len(table) < 4096:
            table[len(table)] = (*last, said[0])
        if len(table) == 1 << width and width < 12:
            width += 1
        last = said
    return out[:n]


def plain_gif(data):
    """(delay, disposal, canvas) of each frame, a pixel at a time."""
    w, h = data[6] | data[7] << 8, data[8] | data[9] << 8
    at, shared = 13, None
    if data[10] & 128:
        n = 2 << (data[10] & 7)
        shared, at = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(n)], 13 + 3 * n
    canvas, out, rule = {}, [], (0, 0, None)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label, at, body = data[at + 1], at + 2, b""
            while data[at]:
                body += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            if label == 0xF9:
                rule = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            continue
        left, top, cols, rows = (data[at + 1 + 2 * i] | data[at + 2 + 2 * i] << 8 for i in range(4))
        flags, at, colours = data[at + 9], at + 10, shared
        if flags & 128:
            n = 2 << (flags & 7)
            colours, at = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)], at + 3 * n
        min_bits, at, body = data[at], at + 1, b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        symbols = plain_lzw(body, min_bits, rows * cols)
        order = range(rows) if not flags & 64 else [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, rows, s)]
        before = dict(canvas)
        for i, y in enumerate(order):
            for x in range(cols):
                v = symbols[i * cols + x]
                if v != rule[2] and left + x < w and top + y < h:
                    canvas[left + x, top + y] = (*colours[v], 255)
        out.append((rule[0], rule[1], [canvas.get((x, y), (0, 0, 0, 0)) for y in range(h) for x in range(w)]))
        if rule[1] == 2:
            for y in range(top, min(h, top + rows)):
                for x in range(left, min(w, left + cols)):
                    canvas.pop((x, y), None)
        elif rule[1] == 3:
            canvas = before
        rule = (0, 0, None)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_against_a_plain_decoder(seed):
    rng = random.Random(seed)
    colours = lambda n: np.array([[rng.randrange(256) for _ in range(3)] for _ in range(n)], dtype=np.uint8)
    shared = colours(rng.choice([2, 4, 16, 200, 256]))
    w, h = rng.randint(1, 24), rng.randint(1, 24)
    parts = []
    for _ in range(rng.randint(1, 6)):
        palette = shared if rng.random() < 0.6 else colours(rng.choice([2, 5, 64]))
        rows, cols = rng.randint(1, h), rng.randint(1, w)
        pixels = np.array([[rng.randrange(len(palette)) if rng.random() < 0.5 else 0 for _ in range(cols)] for _ in range(rows)], dtype=np.uint8)
        parts.append(gif.Frame(pixels, palette, rng.randint(0, w), rng.randint(0, h), rng.randint(0, 300), rng.randint(0, 3), rng.choice([None, 0, len(palette) - 1])))
    data = gif.encode_gif(parts, w, h, shared)
    got = [(f.delay_cs, f.disposal, [tuple(p) for p in f.canvas.reshape(-1, 4).tolist()]) for f in gif.decode_gif(data)]
    assert got == plain_gif(data)
    histogram = [0] * 64
    for r, g, b, a in got[-1][2]:
        histogram[(r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)] += a > 0
    *_, last = gif.decode_gif(data)
    assert gif.colour_histogram(last.canvas).tolist() == histogram


def test_stored_payloads_against_a_plain_decoder():
    for n in (0, 64, 3000, 70_000):
        text = random.Random(n).randbytes(n)
        shown = plain_gif(gif.store_payload(text))
        index = {tuple(c): i for i, c in enumerate(gif.PALETTE.tolist())}
        pixels = bytes(index[p[:3]] for _, _, canvas in shown for p in canvas if p[3])
        assert pixels == text.ljust(max(64, -(-n // 64) * 64), b"\0") and {d for d, _, _ in shown} == {gif.DELAY_CS}
