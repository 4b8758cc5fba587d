"""Many needles in one reading of a text: an Aho-Corasick automaton in flat arrays, all texts of a batch advanced together.

A needle is known by its first ``KEY`` bytes. The automaton over the keys is a table with a row for each prefix of a key
and a column for each kind of byte that keys have (all others are one kind); it is filled level by level, a whole level at
once. Texts are cut into segments of ``SEGMENT`` bytes and as many more as a key can reach over, so a step moves all
segments of a batch by one byte, and steps are as many as a segment has bytes, however long a text is. A needle longer
than its key is looked for in the texts that have the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

KEY, SEGMENT = 24, 4096
#: Hits that are gathered before repeated ones are dropped.
GATHERED = 2_000_000


@dataclass(frozen=True)
class Automaton:
    """kinds: of each byte; after: the state after each state and kind; ends: where the keys that end in a state begin in
    keyed (and where they stop); shorter: the longest proper suffix of a state in which keys end, or 0; any_: whether a
    state or a suffix of it ends a key. keyed: needles by their keys. longer: those that a key alone doesn't prove."""

    kinds: np.ndarray
    after: np.ndarray
    ends: np.ndarray
    keyed: np.ndarray
    shorter: np.ndarray
    any_: np.ndarray
    needles: tuple[bytes, ...]
    key: int

    @classmethod
    def of(cls, needles: Sequence[bytes], key: int = KEY) -> Automaton:
        """The automaton of the needles, none empty; repeated ones are found each."""
        order = sorted(range(len(needles)), key=lambda i: needles[i])
        lengths = np.array([min(key, len(needles[i])) for i in order], np.int64)
        letters = np.zeros((len(order), key), np.uint8)
        for row, i in enumerate(order):
            letters[row, : lengths[row]] = np.frombuffer(needles[i][:key], np.uint8)
        inside = np.arange(key) < lengths[:, None]
        used = np.unique(letters[inside])
        kinds = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        kinds[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        # a prefix is new where it isn't the same one of the needle before
        differ = np.ones_like(inside)
        differ[1:] = (letters[1:] != letters[:-1]) | (inside[1:] != inside[:-1])
        new = np.logical_or.accumulate(differ, axis=1) & inside
        number = np.zeros((len(order), key + 1), np.int64)  # the state of each needle's prefix of each length
        states = 1
        for depth in range(key):
            number[:, depth + 1] = np.where(inside[:, depth], states - 1 + np.cumsum(new[:, depth]), 0)
            states += int(new[:, depth].sum())
        after = np.zeros((states, width), np.int32)
        suffix = np.zeros(states, np.int64)
        for depth in range(key):
            rows = np.flatnonzero(new[:, depth])
            parent, child, kind = number[rows, depth], number[rows, depth + 1], kinds[letters[rows, depth]]
            if depth:
                level = np.unique(number[inside[:, depth - 1], depth])
                after[level] = after[suffix[level]]
                suffix[child] = after[suffix[parent], kind]
            after[parent, kind] = child
        if key:
            level = np.unique(number[inside[:, key - 1], key])
            after[level] = after[suffix[level]]
        at = number[np.arange(len(order)), lengths]
        by_state = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[by_state], np.arange(states + 1))
        own = np.diff(ends) > 0
        shorter, any_ = np.zeros(states, np.int64), own.copy()
        for depth in range(key):
            level = number[np.flatnonzero(new[:, depth]), depth + 1]
            shorter[level] = np.where(own[suffix[level]], suffix[level], shorter[suffix[level]])
            any_[level] |= any_[suffix[level]]
        return cls(kinds, after, ends, np.array(order, np.int64)[by_state], shorter, any_, tuple(needles), key)

    def _met(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, state) as one number, for states that end a key, each once."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        length = np.minimum(sizes[text] - begin, SEGMENT + self.key - 1)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], (offsets[:-1][text] + begin)[order], length[order]
        kinds, flat, width = self.kinds[data], self.after.ravel(), self.after.shape[1]
        state, states = np.zeros(len(text), np.int64), len(self.after)
        met, n, found = [], 0, np.zeros(0, np.int64)
        # segments of the same length end together, the shortest first
        open_ = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for step, m in enumerate(open_.tolist()):
            state = state[:m]
            state = flat[state * width + kinds[begin[:m] + step]].astype(np.int64)
            hit = np.flatnonzero(self.any_[state])
            if len(hit):
                met.append(text[hit] * states + state[hit])
                n += len(hit)
                if n > GATHERED:
                    found, met, n = np.unique(np.concatenate([found, *met])), [], 0
        return np.unique(np.concatenate([found, *met]))

    def found(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, needle) for each needle that a text contains, each pair once; text i is data[offsets[i]:offsets[i + 1]]."""
        met = self._met(np.frombuffer(data, np.uint8), offsets)
        text, state = met // len(self.after), met % len(self.after)
        pairs = []
        while len(state):
            count = self.ends[state + 1] - self.ends[state]
            first = np.repeat(self.ends[state] - (np.cumsum(count) - count), count)
            pairs.append(np.repeat(text, count) * len(self.needles) + self.keyed[first + np.arange(count.sum())])
            state = self.shorter[state]
            text, state = text[state > 0], state[state > 0]
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        text, needle = both // max(1, len(self.needles)), both % max(1, len(self.needles))
        long = np.array([len(x) > self.key for x in self.needles], bool)
        proved = np.ones(len(text), bool)
        for i in np.flatnonzero(long[needle]) if len(needle) else ():
            t = text[i]
            proved[i] = data.find(self.needles[needle[i]], offsets[t], offsets[t + 1]) >= 0
        return text[proved], needle[proved]
