"""Words of whole texts as the lexical operators read them: runs of ASCII letters, digits and anything beyond ASCII.

Only A to Z are lower-cased. In UTF-8 every byte of a character beyond ASCII is 0x80 or above, so one table of 256
bytes does both, and the words are what ``bytes.split`` finds. A null text has no word.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

#: What a byte becomes: itself, its lower case, or a space between words.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_IN_WORD = bytes(int(b != 32) for b in FOLDED)


def words(text: bytes | None) -> list[bytes]:
    """The text's words in order, repeats included."""
    return text.translate(FOLDED).split() if text else []


class Vocabulary(dict[bytes, int]):
    """Numbers words from 0 in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, found: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def texts(column: pa.Array) -> Iterable[bytes | None]:
    """The values of a string column as UTF-8, one at a time."""
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.binary()))


def counts(column: pa.Array) -> np.ndarray:
    """How many words each value of a column has, counted by where a word begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    out, filled = np.zeros(len(column), np.int64), np.flatnonzero(np.diff(offsets) > 0)
    if len(filled):
        held = column.buffers()[2][offsets[0] : offsets[-1]].to_pybytes().translate(_IN_WORD)
        inside = np.frombuffer(held, np.uint8)
        begins = inside.copy()
        begins[1:] &= inside[:-1] ^ 1
        first = offsets[filled] - offsets[0]
        begins[first] = inside[first]
        out[filled] = np.add.reduceat(begins, first, dtype=np.int64)
    return out * column.is_valid().to_numpy(zero_copy_only=False)
