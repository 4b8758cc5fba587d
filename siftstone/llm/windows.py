"""Which classes of equal-length strings of a text can recur: minimizers.

Every string of ``width`` bytes in a text has a minimizer, the grams of ``gram`` bytes in it with the least hash, the
first of equal ones. Equal strings have equal minimizers, so a string recurs only in its minimizer's class. Strings
that follow one another mostly share theirs: the runs ("pieces") are what travels, about two for each
``width - gram`` bytes.
"""

from __future__ import annotations

import numpy as np

#: Odd factor of the rolling hash, and those of its final mixing.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes (a power of two), by doubling."""
    h, factor, size = data.astype(np.uint64) + np.uint64(1), int(BASE), 1
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def pieces(data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, start, n): runs of n strings of a text that share a minimizer occurrence; key: its gram's hash.

    data holds several texts end to end; text i is data[bounds[i]:bounds[i + 1]]. start counts in data.
    """
    none = np.zeros(0, dtype=np.int64)
    lengths = np.diff(bounds)
    if not (lengths >= width).any():
        return none, none.view(np.uint64), none, none
    h = gram_hashes(data, gram)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    size, span = 1, width - gram + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = (least & LOW).astype(np.int64)
    # strings that cross the end of a text are none
    valid = np.zeros(len(at) + 1, dtype=np.int8)
    long = np.flatnonzero(lengths >= width)
    np.add.at(valid, bounds[long], 1)
    np.add.at(valid, bounds[long + 1] - width + 1, -1)
    ok = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change = np.empty(len(at), dtype=bool)
    change[0] = True
    np.not_equal(at[1:], at[:-1], out=change[1:])
    change[bounds[long]] = True
    starts = np.flatnonzero(change & ok)
    # a run ends at the next change or where its text has no further string
    ends = np.flatnonzero(np.append(change, True))
    following = ends[np.searchsorted(ends, starts, side="right")]
    text = np.searchsorted(bounds, starts, side="right") - 1
    n = np.minimum(following, bounds[text + 1] - width + 1) - starts
    return text, h[at[starts]], starts, n


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of ``width`` bytes, for any width, from those of its power-of-two parts."""
    powers, factor, h, size = {}, int(BASE), data.astype(np.uint64) + np.uint64(1), 1
    while size <= width:
        if width & size:
            powers[size] = (h, factor)
        if 2 * size <= width:
            h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        size *= 2
    n, at, out = len(data) - width + 1, 0, None
    for size in sorted(powers, reverse=True):
        h, factor = powers[size]
        part = h[at : at + n]
        out = part.copy() if out is None else out * np.uint64(factor) + part
        at += size
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ out >> np.uint64(29)
