"""Dual-sorted posting lists: one sequence of documents that is read by impact and by document number.

The lists of a shard stand end to end, each by falling impact. Their documents are kept as a wavelet tree without
pointers: level i has a bit for each posting, the i-th bit of its document's number from the top, and deals the postings
to the next level by it, zeros before ones, in their order otherwise. A node is a range of document numbers; counting
bits maps a list to its part in either child, and as the order stays, that part's first posting has its greatest
impact. So the sum of the first impacts of all lists of a search bounds what any document below a node can score, and
at the last level it is the score itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes that a step of a search opens together.
WIDTH = 64


def depth_of(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def level_bits(docs: np.ndarray, depth: int) -> bytes:
    """The tree over the postings' documents: the levels' bits, each level filled up to whole bytes."""
    out = []
    for level in range(depth):
        bit = (docs >> (depth - 1 - level) & 1).astype(bool)
        out.append(np.packbits(bit).tobytes())
        docs = np.concatenate([docs[~bit], docs[bit]])
    return b"".join(out)


@dataclass
class Tree:
    """What searches read: at each level the ones before each place and the impacts in its order, and where ones begin."""

    depth: int
    ones: np.ndarray
    impacts: np.ndarray
    zeros: np.ndarray

    @classmethod
    def load(cls, bits: bytes, impacts: np.ndarray, depth: int) -> Tree:
        n = len(impacts)
        ones, by_level = np.zeros((depth, n + 1), np.int32), np.zeros((depth + 1, n + 1), np.int32)
        packed = np.frombuffer(bits, np.uint8).reshape(depth, -1)
        by_level[0, :n] = impacts
        for level in range(depth):
            bit = np.unpackbits(packed[level], count=n)
            np.cumsum(bit, out=ones[level, 1:])
            here, bit = by_level[level, :n], bit.astype(bool)
            zeros = n - int(ones[level, n])
            by_level[level + 1, :zeros], by_level[level + 1, zeros:n] = here[~bit], here[bit]
        return cls(depth, ones, by_level, n - ones[:, n].astype(np.int64))


@dataclass
class Nodes:
    """Nodes of one search: level, document numbers' leading bits, each list's part there, and the bound of their scores."""

    level: np.ndarray
    prefix: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray

    def at(self, which: np.ndarray) -> Nodes:
        return Nodes(self.level[which], self.prefix[which], self.low[which], self.high[which], self.bound[which])

    def joined(self, other: Nodes) -> Nodes:
        return Nodes(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("level", "prefix", "low", "high", "bound")))


def _bounded(tree: Tree, weights: np.ndarray, level: np.ndarray, prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> Nodes:
    return Nodes(level, prefix, low, high, ((low < high) * tree.impacts[level[:, None], low].astype(np.int64) * weights).sum(axis=1))


def _children(tree: Tree, weights: np.ndarray, of: Nodes) -> Nodes:
    level = of.level[:, None]
    low, high = tree.ones[level, of.low].astype(np.int64), tree.ones[level, of.high].astype(np.int64)
    zeros = tree.zeros[of.level][:, None]
    return _bounded(tree, weights, np.tile(of.level + 1, 2), np.concatenate([2 * of.prefix, 2 * of.prefix + 1]), np.concatenate([of.low - low, zeros + low]), np.concatenate([of.high - high, zeros + high]))


def search(tree: Tree, low: np.ndarray, high: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores), best first and equal ones by document: the k best documents of at least ``least``, exactly.

    The lists are low to high in the sequence, their impacts count ``weights`` times. Always the open nodes of the
    highest bounds are opened, and none that is below the k-th score found so far; one that equals it may hold a tie.
    """
    at_root = np.zeros(1, np.int64)
    open_ = _bounded(tree, weights, at_root, at_root, low[None].astype(np.int64), high[None].astype(np.int64))
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = max(1, least)
    while True:
        open_ = open_.at(open_.bound >= least)
        if not len(open_.bound):
            return found, scores
        rest = open_.at(np.zeros(0, np.int64))
        if len(open_.bound) > WIDTH:
            by_bound = np.argpartition(-open_.bound, WIDTH)
            open_, rest = open_.at(by_bound[:WIDTH]), open_.at(by_bound[WIDTH:])
        leaf = open_.level == tree.depth
        if leaf.any():
            found, scores = np.concatenate([found, open_.prefix[leaf]]), np.concatenate([scores, open_.bound[leaf]])
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                least = max(least, int(scores[-1]))
        open_ = rest.joined(_children(tree, weights, open_.at(~leaf)))
