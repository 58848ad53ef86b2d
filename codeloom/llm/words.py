"""Words of whole texts as NumPy arrays over an Arrow column.

A word is a maximal run of bytes other than space and \\x09-\\x0D, the same as `[^\\x20\\x09-\\x0D]+` on the text. A batch
is cut into slices of whole documents of about `SLICE_BYTES`, so that the arrays of a task stay small; a document larger
than that is a slice of its own. Words and shingles are named by 64-bit hashes of their bytes: equal words have equal
names on every machine, different words collide with probability 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_LONG_WORD = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
STEP = _A


class Slice(NamedTuple):
    """Whole documents of a batch: rows [first, last), their bytes, and their words."""

    first: int
    last: int
    data: np.ndarray  # bytes of the documents, one after the other, eight zero bytes at the end
    offsets: np.ndarray  # where each document starts in data, and the end
    starts: np.ndarray  # where each word starts in data
    ends: np.ndarray
    word_offsets: np.ndarray  # first word of each document, and the end

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each ordered pair of names."""
    return mix(left * _A + mix(right + _C))


def slices(column: pa.Array, lower: bool = False, words: bool = True) -> Iterator[Slice]:
    """The words of every document; a null text has none. Without words, only the bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        own = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        none = np.zeros(0, np.int64)
        yield Slice(first, last, *(_bounds(own, at, lower) if words else (own, at, none, none, none)))
        first = last


def _bounds(own: np.ndarray, at: np.ndarray, lower: bool) -> tuple:
    size = len(own)
    data = np.zeros(size + 8, np.uint8)
    data[:size] = _LOWER[own] if lower else own
    space = SPACE[own]
    cut = np.zeros(size + 1, bool)  # a document begins here
    cut[at] = True
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return data, at, starts, ends, np.searchsorted(starts, at)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit name of each piece of data; data has eight bytes to spare at its end."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + _A)
    at = np.flatnonzero(lengths > 0)
    step = 0
    while len(at) and step < _LONG_WORD:
        left = lengths[at] - step
        part = eights[starts[at] + step] & _MASK[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ part) * _A + _C)
        at = at[left > 8]
        step += 8
    for i in at:  # very long words: the rest by a digest
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def word_names(part: Slice) -> np.ndarray:
    return names(part.data, part.starts, part.ends)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each word, from the first word of each document."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
