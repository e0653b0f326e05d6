"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D (so Unicode spaces
are part of words). ``Words`` finds every word of a batch and a 64-bit hash of each
in a few numpy passes over the batch's UTF-8 buffer, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


#: A random-looking value per byte; the second table treats A-Z as a-z.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
_powers: dict[int, np.ndarray] = {}
#: Bytes that are hashed at a time (a longer word by itself).
HASH_BYTES = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and grown when a longer batch comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, U64)
        done = 1
        while done < size:  # doubling: the next run is this run times base**done
            out[done:2 * done] = out[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of the rows of a batch: ``starts``/``ends`` in ``data``, ``first[i]:first[i+1]`` are row i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray = SPACE):
        space = separators[data]
        before = np.empty(len(data), bool)
        before[:1] = True
        before[1:] = space[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = True  # a row's first byte starts a word, whatever ends the row before
        after = np.empty(len(data), bool)
        after[-1:] = True
        after[:-1] = before[1:] & ~space[1:] | space[1:]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._space, self._lower = space, lower

    def hashes(self, values: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash per word: a polynomial of its bytes' values, independent of its place.

        Worked out for some bytes at a time, so that the tables of powers stay small."""
        if values is None:
            values = LOWER if self._lower else BYTE
        out = np.empty(len(self.starts), U64)
        first = 0
        while first < len(out):
            begin = int(self.starts[first])
            last = max(first + 1, int(np.searchsorted(self.ends, begin + HASH_BYTES, side="right")))
            end = int(self.ends[last - 1])
            total = np.zeros(end - begin + 1, U64)
            np.cumsum(values[self.data[begin:end]] * powers(_ODD, end - begin), out=total[1:])
            at, to = self.starts[first:last] - begin, self.ends[first:last] - begin
            out[first:last] = (total[to] - total[at]) * powers(_INV, end - begin)[at]
            first = last
        return mix(out + (self.ends - self.starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def rows(self) -> np.ndarray:
        """The row number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def code_points(self) -> np.ndarray:
        """Code points inside words, per row."""
        return self.count(~self._space & ((self.data & 0xC0) != 0x80))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one per byte) in each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (across row borders too; see ``inside``)."""
    out = h[:max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[i:len(h) - n + 1 + i])
    return out


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each run of ``n`` consecutive words of the batch: does it lie in one row?"""
    total = int(first[-1]) if len(first) else 0
    runs = max(0, total - n + 1)
    start = np.arange(runs)
    row_end = np.repeat(first[1:], np.diff(first))[:runs]
    return start + n <= row_end


def pieces(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``max_bytes`` of text (a longer row is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def hash_words(words: list[str]) -> np.ndarray:
    """The lower-case hashes that ``Words`` gives these words."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), lower=True).hashes()
