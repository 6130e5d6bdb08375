"""Word and shingle hashes of Arrow text columns, computed on whole buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased. Hashes have 64 bits: a word's is polynomial over its
bytes, a shingle's polynomial over its words, both mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of words and of shingles of ``k`` words."""

    def __init__(self, k: int = 5) -> None:
        self.k = k
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.bytes = mix64(lower + np.uint64(0x51ED27)) | np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inv = pow(int(_PRIME), -1, 1 << 64)
            for name, base in (("power", _PRIME), ("inverse", np.uint64(inv))):
                steps = np.full(max(n, CHUNK), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of a chunk, and for each text where its words begin (one more entry at the end)."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n)
        space = self.space[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[offsets[:-1][offsets[:-1] < n]] = True
        after[offsets[1:] - 1] = True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.power[:n], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * self.inverse[starts]), np.searchsorted(starts, offsets)

    def windows(self, words: np.ndarray, k: int | None = None) -> np.ndarray:
        """Hashes of all runs of ``k`` words of a chunk; those that cross the end of a text are to be left out."""
        k = k or self.k
        if len(words) < k:
            return np.empty(0, np.uint64)
        h = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            h *= _PRIME
            h += words[i : len(words) - k + 1 + i]
        return mix64(h + np.uint64(k))

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """For each text its row and its set of shingle hashes, ascending.

        A text with fewer than ``k`` words has its whole sequence as one shingle, a text without words (or null) none.
        """
        for first, data, offsets in chunks(column):
            words, at = self.words(data, offsets)
            full = self.windows(words)
            for i in range(len(offsets) - 1):
                a, b = at[i], at[i + 1]
                if b - a >= self.k:
                    s = np.sort(full[a : b - self.k + 1])
                    keep = np.ones(len(s), bool)
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    yield first + i, s[keep]
                else:
                    yield first + i, self.windows(words[a:b], b - a) if b > a else np.empty(0, np.uint64)


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a text column into (first row, UTF-8 bytes, offsets of the texts) of about ``CHUNK`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def digest(values: np.ndarray) -> int:
    """A 63-bit hash of an ascending set of shingle hashes."""
    n = len(values)
    order = mix64(np.arange(1, n + 1, dtype=np.uint64) * _PRIME)
    h = np.add.reduce(mix64(values ^ order)) + np.uint64(n)
    return int(mix64(np.asarray([h], np.uint64))[0] >> np.uint64(1))
