"""Column-wise construction of a collection's Burrows-Wheeler transform with its common prefixes.

The documents of a collection grow from their last symbol to their first, one symbol each per round. A round reads
the transform and the common-prefix lengths once in order, finds for each document where its lengthened suffix sorts
(by counting the symbol up to the place of the suffix before), and writes both sequences out again in order with the
new entries put in: two sequential streams in, two out. Nothing else of the collection's size outlives a round. Every
document ends in an end mark of its own, smaller than any byte and ordered by document, so suffixes of different
documents that read the same stand side by side, with the length of what they share.

Common prefixes are stored up to ``cap``, all that the caller asks about. Collections here are bounded by their
caller, so the streams are memory buffers; a round touches them in order only.
"""

from __future__ import annotations

import numpy as np

#: The transform's symbol before a whole document; bytes are stored one higher, so 0xFF (never in UTF-8) can't occur.
END = 0


def _symbol_order(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places by (symbol, place), each place's number in that order, and how many END symbols there are."""
    order = np.argsort(bwt, kind="stable")
    number = np.empty(len(bwt), dtype=np.int32)
    number[order] = np.arange(len(bwt), dtype=np.int32)
    return order, number, len(bwt) - int(np.count_nonzero(bwt))


def _insert(stream: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The stream written out again with the values put in so that they end up at the (ascending) places."""
    return np.insert(stream, places - np.arange(len(places)), values)


def build(documents: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp): each suffix's preceding symbol in suffix order, and its common prefix with the suffix before it, up to cap (< 255)."""
    n = len(documents)
    lengths = np.fromiter(map(len, documents), np.int64, n)
    longest = int(lengths.max(initial=0))
    columns = np.zeros((longest + 1, n), dtype=np.uint8)  # column k: the symbol k from the end, then END
    for j, d in enumerate(documents):
        columns[: len(d), j] = np.frombuffer(d, dtype=np.uint8)[::-1] + np.uint8(1)
    # round 0: the empty suffixes, each with its document's last symbol before it
    bwt, lcp = columns[0].copy(), np.zeros(n, dtype=np.uint8)
    active = np.flatnonzero(lengths > 0)
    places = active.copy()  # where each active document's longest suffix so far stands
    for k in range(longest):
        symbols = columns[k, active]
        by_symbol, number, ends = _symbol_order(bwt)
        rank = number[places].astype(np.int64)
        arrived = n + rank - ends  # the empty suffixes come first, then one suffix for each symbol but END
        # a suffix shares one symbol more with its neighbour than what follows in both shares, if the symbols agree
        padded = np.append(lcp, lcp[-1:])

        def shared(near: np.ndarray, after: bool, rank: np.ndarray = rank, by_symbol: np.ndarray = by_symbol, bwt: np.ndarray = bwt, padded: np.ndarray = padded, symbols: np.ndarray = symbols, places: np.ndarray = places) -> np.ndarray:
            inside = (near >= 0) & (near < len(bwt))
            at = by_symbol[np.where(inside, near, rank)]
            alike = inside & (bwt[at] == symbols)
            at = np.where(alike, at, places)
            low, high = (places, at) if after else (at, places)
            cuts = np.empty(2 * len(places), dtype=np.int64)
            cuts[::2] = np.where(alike, low + 1, 0)
            cuts[1::2] = np.where(alike, high + 1, 1)
            least = np.minimum.reduceat(padded, cuts)[::2].astype(np.int64)
            return np.where(alike, np.minimum(least + 1, cap), 0).astype(np.uint8)

        before, behind = shared(rank - 1, False), shared(rank + 1, True)
        order = np.argsort(arrived)
        to = arrived[order]
        bwt = _insert(bwt, to, columns[k + 1, active][order])
        lcp = _insert(lcp, to, before[order])
        inner = to + 1 < len(lcp)
        lcp[to[inner] + 1] = behind[order][inner]
        places = arrived
        if k + 1 < longest:
            going = lengths[active] > k + 1
            active, places = active[going], places[going]
    return bwt, lcp


def repeated_starts(documents: list[bytes], weights: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document: whether the string of ``width`` bytes at each place recurs, in it or another; a weight of 2 or more is a copy."""
    n = len(documents)
    lengths = np.fromiter(map(len, documents), np.int64, n)
    bwt, lcp = build(documents, width)
    again = lcp >= width
    again[:-1] |= again[1:]
    out = [np.zeros(max(0, m - width + 1), dtype=bool) for m in lengths.tolist()]
    _, number, ends = _symbol_order(bwt)
    step = n - ends + number.astype(np.int64)
    # from each document's empty suffix to ever longer ones
    places, live = np.arange(n), np.arange(n)
    flags = np.zeros((int(lengths.max(initial=0)) + 1, n), dtype=bool)
    for k in range(1, int(lengths.max(initial=0)) + 1):
        going = lengths[live] >= k
        live, places = live[going], step[places[going]]
        flags[k, live] = again[places]
    for j, m in enumerate(lengths.tolist()):
        if m >= width:
            out[j] = flags[width : m + 1, j][::-1] | (weights[j] > 1)
    return out
