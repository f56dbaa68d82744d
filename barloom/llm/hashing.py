"""Word hashes of many texts at once, on the bytes of an Arrow column.

Every byte adds (its own random number) * BASE ** (its place) to a running sum modulo 2 ** 64. The
difference of the sum at a word's end and start, brought back to place 0, is the word's polynomial
hash; mixing makes it a good 64-bit hash. Hashes of several neighbouring words are polynomials of
word hashes, mixed again. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one go (a longer text is one go of its own).
CHUNK_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


class WordHasher:
    """Splits and hashes the words of a column; keeps its tables of powers from batch to batch.

    ``separators`` are the bytes between words. With ``lower``, ASCII capitals
    hash as small letters.
    """

    def __init__(self, separators: bytes = b"\x20\x09\x0a\x0b\x0c\x0d", lower: bool = False):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(separators)] = False
        self.numbers = _BYTES.copy()
        if lower:
            self.numbers[65:91] = self.numbers[97:123]
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]

    def words(
        self, data: np.ndarray, offsets: np.ndarray, heads: tuple[int, ...] = ()
    ) -> tuple[np.ndarray, ...]:
        """(starts, ends, hashes, first): bytes and hashes of all words, and each text's first word.

        ``offsets`` are the limits of the texts in ``data``; ``first`` has one
        entry more than there are texts. For each number in ``heads`` the hashes
        of the words' first so many bytes follow (shorter words whole).
        """
        base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
        limits = offsets - base
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = self.is_word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # a text's end ends a word, even where the next text starts with one
        begins[limits[:-1]] = inside[limits[:-1]]
        begins[-1] = False
        starts = np.flatnonzero(begins)
        ends_here = ~inside
        ends_here[limits[1:]] = True
        stops = np.flatnonzero(ends_here)
        ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
        up, down = self._tables(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.numbers[data] * up[:-1], out=total[1:])
        stops = [ends, *[np.minimum(starts + n, ends) for n in heads]]
        hashes, *more = [mixed((total[x] - total[starts]) * down[starts]) for x in stops]
        first = np.searchsorted(starts, limits)
        return starts + base, ends + base, hashes, first, *more


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbouring words (across texts too: see ``gram_counts``)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    sums = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            sums = sums * _BASE + hashes[i : i + m]
    return mixed(sums)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    limits = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw, limits.astype(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
