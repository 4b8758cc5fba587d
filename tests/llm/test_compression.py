import base64
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from siftstone.llm import compression

DOCS = "doc_id long, text string, ratio string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RNG = random.Random(8)
_SYLLABLES = ["ber", "lan", "tor", "win", "mar", "sel", "dun", "ker", "fol", "ash"]
PROSE = " ".join("".join(_RNG.choice(_SYLLABLES) for _ in range(_RNG.randint(1, 3))) for _ in range(300)) + "."


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def judged(spark, texts):
    rows = compression.judge(spark.createDataFrame([(i, t, "r", 0) for i, t in enumerate(texts)], DOCS)).collect()
    return [r for _, r in sorted((r["key"], r) for r in rows)]


def test_base_counts_against_brute_force(spark):
    texts = [None, "", " \n\t\v", "a b c a b c", "a b c d a b c", "x", "line\nline\n line\n\n \nline", "é b c d", "a a a a", "# <b>*|$%&", "a b\x1fc\x0bd", PROSE, "w " * 200_000, "a\rb\r\na"]
    for text, r in zip(texts, judged(spark, texts), strict=True):
        want = brute(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_bands(spark):
    noise = lambda n: base64.b64encode(os.urandom(n)).decode()
    words = " ".join(noise(12) for _ in range(400))
    half = PROSE + "\n" + " ".join(noise(12) for _ in range(2000))
    spaced = " ".join(f"{i % 2}{'qwertyuiop' * 9} {i}" for i in range(300))
    kept, noisy, half_noisy, repetitive = judged(spark, [PROSE, words, half, spaced])
    assert kept["kept"] and kept["ratio"] > 1.3
    assert noisy["reason"] == "whole text incompressible" and not noisy["kept"]
    assert half_noisy["reason"] is not None
    assert "repetitive" in repetitive["reason"]


def test_chunks_are_measured_to_the_end():
    squeeze = zstandard.ZstdCompressor(level=compression.LEVEL)
    noise = random.Random(1).randbytes(2 * compression.CHUNK)
    whole, chunks = compression.ratios(b"a" * compression.CHUNK + noise + b"rest", squeeze)
    assert len(chunks) == 4 and chunks[0] > 50 and max(chunks[1:]) < 1.01 and 1.3 < whole < 2
    assert compression.ratios(b"", squeeze) == (None, [])
    assert [len(compression.ratios(b"x" * n, squeeze)[1]) for n in (1, 255, 511, 512, 513, 1024, 2047, 2048, 4096, 4097)] == [1, 1, 1, 2, 3, 2, 4, 2, 1, 2]


def test_empty(spark):
    assert judged(spark, []) == []


def test_the_whole_text_is_judged_in_chunks(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(1500))
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    clean = [prose[:n] for n in (700, 1500, 3000, 4096, 7996)]
    tails = [prose[:a] + noise(b) for a, b in ((4096, 3900), (4096, 1500), (1500, 1500), (800, 700))]
    repeats = prose[:4096] + " ".join(["again and again"] * 250)
    rows = judged(spark, [*clean, *tails, repeats])
    assert [r["reason"] for r in rows[:5]] == [None] * 5 and all(r["least_chunk_ratio"] for r in rows)
    assert [r["reason"] for r in rows[5:9]] == ["chunks incompressible"] * 4
    assert not rows[9]["kept"]


def prose(rng, n):
    out = " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n // 5 + 10))
    return out[:n]


def verdicts(texts):
    """Each text's reason, by plain loops over all texts."""
    squeeze = zstandard.ZstdCompressor(level=compression.LEVEL)
    rows = []
    for t in texts:
        body = (t or "").encode()
        n_words, _, _, _, repeated = brute(t)
        size = next((u for at, u in ((4096, 4096), (2048, 1024), (1024, 512), (512, 256)) if len(body) >= at), len(body))
        parts = [(body[i : i + size], size) for i in range(0, len(body) - size + 1, size)] if body else []
        if body and len(body) % size:
            parts.append((body[-max(min(512, size), len(body) % size) :], len(body) % size))
        ratio = lambda x: len(x) / len(squeeze.compress(x))
        rows.append((len(body), size, n_words < 50 or 100 * repeated > 50 * n_words, ratio(body) if body else None, [(ratio(x), len(x), b) for x, b in parts]))
    quarter = lambda n: (n.bit_length(), f"{n:b}00"[1:3])
    bands = defaultdict(list)
    for n, _, failed, whole, parts in dict(zip(texts, rows, strict=True)).values():
        if failed:
            continue
        bands[quarter(n)].append(whole)
        for r, m, _ in parts:
            bands["chunk", quarter(m)].append(r)
    limits = {}
    for k, rs in bands.items():
        rs = sorted(round(math.log(r) * 2000) for r in rs)
        q1, q2, q3 = (math.exp(rs[math.ceil(len(rs) * s) - 1] / 2000) for s in (0.25, 0.5, 0.75))
        below, above = (max(4 * (q3 - q1), share * q2 * (1 + 20 / len(rs))) for share in (0.15, 0.08))
        limits[k] = q2 - below, q2 + above
    outer = lambda n: next(b[1:] for b in compression.WHOLE if n < b[0])
    out = []
    for n, size, failed, whole, parts in rows:
        if failed:
            out.append("base rules")
            continue
        low, high = max(limits[quarter(n)][0], outer(n)[0]), min(limits[quarter(n)][1], outer(n)[1])
        above = below = 0
        for r, m, b in parts:
            c_outer = compression.CHUNKS if m == 4096 else outer(m)
            above += b * (r > min(limits["chunk", quarter(m)][1], c_outer[1]))
            below += b * (r < max(limits["chunk", quarter(m)][0], c_outer[0]))
        why = "whole text repetitive" if whole > high else "whole text incompressible" if whole < low else None
        if why is None and above + below > 0.25 * n:
            why = "chunks repetitive" if above >= below else "chunks incompressible"
        out.append(why)
    return out


def test_verdicts_against_brute_force(spark):
    rng = random.Random(11)
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    spaced = lambda n: " ".join(noise(7) for _ in range(n // 8 + 1))[:n]
    marks = lambda n: " ".join(w + "#####" for w in prose(rng, n).split())[:n]
    lengths = [600, 700, 900, 1500, 3000, 5000, 9000]
    clean = [prose(rng, rng.randint(n, n + n // 8)) for n in lengths for _ in range(60)]
    bad = [f(n) for n in lengths[2:] for f in (spaced, marks)] + [prose(rng, 3000) + spaced(2400), prose(rng, 5000) + marks(4000)]
    odd = [None, "", "a", " ", prose(rng, 300_000), "w " * 100_000, *[clean[-1]] * 300]
    texts = [*clean, *bad, *odd]
    want = verdicts(texts)
    assert [r["reason"] for r in judged(spark, texts)] == want
    assert not any(want[: len(clean)])
    assert all(want[len(clean) : len(clean) + len(bad)])
    assert {"whole text repetitive", "whole text incompressible"} <= set(want)
    # copies don't set the limits, and equal texts get equal verdicts
    assert set(want[-300:]) == {want[len(clean) - 1]}


def test_limits_are_those_of_texts_at_any_number(spark):
    # many different texts of a few lengths and ratios: pairs of those would forget how often each is there
    steps = [round(math.exp(round(random.Random(i).gauss(math.log(2.1), 0.03) * 500) / 500), 4) for i in range(2_000)]
    found = []
    for times in (1, 10):
        rows = spark.createDataFrame([(i, 1024 + i % 7, 1024 + i % 7, r, [r]) for i, r in enumerate(steps * times)], "h long, n_bytes long, unit long, ratio double, chunks array<double>")
        whole = {r["band"]: r for r in compression.limits(rows).collect() if not r["chunk"]}
        assert len(whole) == 1
        low, high = next((r["low"], r["high"]) for r in whole.values())
        q1, q2, q3 = np.quantile(np.log(steps * times), [0.25, 0.5, 0.75], method="inverted_cdf")
        q1, q2, q3 = np.exp([q1, q2, q3])
        few = 1 + compression.FEW / len(steps * times)
        assert low == pytest.approx(q2 - max(4 * (q3 - q1), 0.15 * q2 * few), rel=2e-3)
        assert high == pytest.approx(q2 + max(4 * (q3 - q1), 0.08 * q2 * few), rel=2e-3)
        found.append((low, high))
    assert found[0] == pytest.approx(found[1], rel=2e-3)


def test_both_sides_count_together(spark):
    rng = random.Random(5)
    squeezed = lambda n: " ".join(f"{i} qwerty asdfgh zxcvbn" for i in range(n // 20))[:n]
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    size = compression.CHUNK
    some = prose(rng, 14 * size) + noise(size) + squeezed(size)
    many = prose(rng, 6 * size) + noise(size) + squeezed(2 * size)
    got = judged(spark, [prose(rng, 9 * size) for _ in range(40)] + [some, many])
    assert got[-2]["reason"] is None and got[-1]["reason"] is not None and not any(r["reason"] for r in got[:40])
