"""Whole Arrow string columns cut into words, and hashes of words and shingles, with numpy only.

A word or shingle is known by a 64-bit hash, nonlinear in blocks of eight bytes. Two different shingles of one pair of texts get the same hash with a
chance of about 2**-64, which is left out of account; equal sets are confirmed by hashes of a second seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Masks of a block's first n bytes.
TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Classes of bytes: words are maximal runs of bytes of one class other than 0.
VISIBLE = np.ones(256, np.uint8)
VISIBLE[SPACES] = 0
LINES = np.ones(256, np.uint8)
LINES[0x0A] = 0
#: Letters, digits, underscores and all that is not ASCII in one class, other visible bytes in another.
PUNCTUATED = np.full(256, 2, np.uint8)
PUNCTUATED[SPACES] = 0
PUNCTUATED[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + U64(seed)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """The words of some texts: byte positions in data, and of each text the range of its words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of text i: words first[i] to first[i + 1]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: its blocks of eight bytes, each mixed with its number and then summed, mixed again with the length.

        Both steps are nonlinear, unlike a polynomial, whose collisions can be written down. Hashes of two seeds are independent.
        """
        if not len(self.start):
            return np.zeros(0, U64)
        size = self.end - self.start
        blocks = (size + 7) >> 3
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)]).tobytes()
        found = np.ndarray(len(self.data), "<u8", padded, 0, (1,))[np.repeat(self.start, blocks) + 8 * place]
        last = first + blocks - 1
        found[last] &= TAILS[size - 8 * (blocks - 1)]
        keys = mixed(np.arange(1, int(blocks.max()) + 1, dtype=U64), 2 * seed + 1)
        sums = np.add.reduceat(mixed(found ^ keys[place]), first)
        with np.errstate(over="ignore"):
            return mixed(sums + size.astype(U64) * U64(0xD6E8FEB86659FD93), seed)

    def shingles(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets by text) of all word shingles; a text with fewer words than width, but some, has one of all its words."""
        h, first = self.hashes(seed), self.first
        counts = np.diff(first)
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        # the first word of each shingle
        at = np.repeat(first[:-1] - offsets[:-1], sizes) + np.arange(offsets[-1])
        long = np.minimum(width, np.repeat(counts, sizes))
        out = np.zeros(offsets[-1], U64)
        with np.errstate(over="ignore"):
            for k in range(width):
                here = long > k
                out[here] = mixed(out[here] * U64(0x2545F4914F6CDD1D) + h[at[here] + k], k + 1)
            return mixed(out, 0x1000), offsets


def text_blocks(column: pa.Array, most_bytes: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of rows with at most most_bytes each, or one row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, int(offs[i]) + most_bytes, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1].astype(np.int64) - int(offs[i])
        i = j


def cut_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = VISIBLE, lower: bool = True) -> Words:
    """The maximal runs of bytes of one class other than 0; ASCII letters in lower case if asked. Words end with their text."""
    if lower:
        data = LOWER[data]
    kind = classes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    last = edge[1:].copy()
    last[:-1] |= kind[1:] != kind[:-1]
    start, end = np.flatnonzero((kind > 0) & new), np.flatnonzero((kind > 0) & last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))
