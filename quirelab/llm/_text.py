"""Words, shingles and window hashes over Arrow batches, in numpy.

A word is a maximal run without ASCII white space, `[^\\x20\\x09-\\x0D]+`, which is exactly what
`bytes.split()` yields. Windows of k words are hashed from prefix sums of a polynomial over the bytes,
so a window costs one subtraction whatever k is.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CHUNK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and the powers of base and of its inverse modulo 2^64."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))

    def powers(b: int) -> np.ndarray:
        p = np.full(size, b, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return byte, powers(base), powers(pow(base, -1, 1 << 64))


class Words:
    """The words of some texts in one buffer: positions, and hashes of windows of words."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        if lower:
            texts = [t.lower() if t else t for t in texts]  # bytes.lower() changes A-Z only
        split = [t.split() if t else [] for t in texts]
        self.split = split
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.doc = np.repeat(np.arange(len(split)), self.count)
        self.buf = np.frombuffer(b" ".join([b" ".join(w) for w in split if w]) + b" ", np.uint8)
        if len(self.doc):
            self.end = np.flatnonzero(self.buf == 32)
            self.start = np.concatenate(([0], self.end[:-1] + 1))
        else:
            self.end = self.start = np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _prefix(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which in self._sums:
            return self._sums[which]
        size = max(2 * _CHUNK, 1 << int(len(self.buf)).bit_length())
        byte, power, inverse = _tables(_BASES[which], size)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(byte[self.buf] * power[: len(self.buf)], out=sums[1:])
        self._sums[which] = sums, inverse
        return sums, inverse

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of k words inside one text."""
        n = len(self.doc)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, self.spans(at, at + k - 1, which)

    def spans(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        sums, inverse = self._prefix(which)
        a = self.start[first]
        return mix((sums[self.end[last]] - sums[a]) * inverse[a])

    def shingles(self, k: int, both: bool = False) -> tuple[np.ndarray, ...]:
        """Text index and hash of the distinct k-word shingles of each text, sorted by both; with `both`, distinct by two hashes, the second one as well.

        A text of 1 to k-1 words has its whole sequence as its one shingle; one without words has none.
        """
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        keys = []
        for which in (0, 1)[: 1 + both]:
            at, h = self.windows(k, which)
            keys.append(np.concatenate((h, self.spans(self.first[short], self.first[short + 1] - 1, which))) if len(short) else h)
        keys.append(np.concatenate((self.doc[at], short)))
        keys = keys[1:-1] + [keys[0], keys[-1]]  # the first hash sorts before the second
        order = np.lexsort(keys)
        keys = [x[order] for x in keys]
        if len(order):
            new = np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in keys])))
            keys = [x[new] for x in keys]
        return tuple(keys[::-1])


def _trim() -> None:
    """Gives freed memory back to the system: what Arrow's pool keeps, and what the C library does where it can be told to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task. After each, freed memory goes back: Python workers stay alive beside the heap of executors while other stages run."""
    for batch in batches:
        yield batch
        del batch
        _trim()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(*columns: pa.Array | pa.ChunkedArray, limit: int = _CHUNK, most: int = 2048) -> Iterator[tuple[int, int]]:
    """Bounds of runs of `most` rows at most, whose texts have about `limit` bytes together, so that work arrays stay small; no text is cut."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    lo = total = 0
    for i, n in enumerate(size.tolist()):
        if i > lo and (total + n > limit or i - lo == most):
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(size):
        yield lo, len(size)
