"""Vectorised view of a batch of UTF-8 texts.

A :class:`TextBlock` holds many whole texts as one byte array with offsets
and hashes any byte range of it in constant time, so that words, lines,
shingles and k-grams of a batch are handled by array operations instead of
per-token Python.  Hashes are 64 bit and serve as identities: two different
strings of a corpus with n distinct strings meet with probability about
n*n / 2**65.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and the base of the polynomial (odd, so that it has an inverse).
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 2 << 20


def _find_trim():
    """glibc keeps freed blocks of up to 32 MB for itself; this gives them back, where there is such a call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


_malloc_trim = _find_trim()


def trim() -> None:
    """Called when a task or group ends, as Python workers live on for the next stage."""
    _malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:  # a very long text's are not kept
            _powers[base] = have
    return have[:n]


class TextBlock:
    """Texts ``i`` are ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._prefix = self._words = self._word_hashes = None

    @classmethod
    def of(cls, texts: list) -> TextBlock:
        return cls.from_arrow(pa.array(texts, pa.string()))

    @classmethod
    def from_arrow(cls, column) -> TextBlock:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def part(self, lo: int, hi: int) -> TextBlock:
        """Texts from ``lo`` to before ``hi``."""
        at = self.offsets[lo : hi + 1]
        return TextBlock(self.data[at[0] : at[-1]], at - at[0])

    def lowered(self) -> TextBlock:
        return TextBlock(LOWER[self.data], self.offsets)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            out = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_BASE, len(self.data)), out=out[1:])
            self._prefix = out
        return self._prefix

    def hash_ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each data[start:end]; equal strings have equal hashes wherever they stand."""
        p = self.prefix
        return mix((p[end] - p[start]) * powers(_INVERSE, len(self.data) + 1)[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def spread_ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A cheaper hash of each data[start:end], good in its high bits only."""
        p = self.prefix
        h = (p[end] - p[start]) * powers(_INVERSE, len(self.data) + 1)[start] + end.astype(np.uint64) - start.astype(np.uint64)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def rolling(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position, for all positions that have k bytes after them in the block."""
        n = len(self.data) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        p = self.prefix
        return mix((p[k:] - p[:n]) * powers(_INVERSE, len(self.data) + 1)[:n])

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Per text, the sum of a per-byte array."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_hashes(self) -> np.ndarray:
        if self._word_hashes is None:
            start, end, _ = self.words()
            self._word_hashes = self.hash_ranges(start, end)
        return self._word_hashes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and per text the index of its first word (n + 1 entries)."""
        if self._words is None:
            self._words = self._find_words()
        return self._words

    def _find_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = np.zeros(len(self.data) + 2, bool)
        solid[1:-1] = ~SPACE[self.data]
        start = np.flatnonzero(solid[1:-1] & ~solid[:-2])
        end = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
        cuts = np.unique(self.offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        cuts = cuts[solid[1:][cuts] & solid[:-1][cuts]]  # words that two texts share at their border
        if len(cuts):
            start, end = (np.insert(x, np.searchsorted(x, cuts), cuts) for x in (start, end))
        return start, end, np.searchsorted(start, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every \\n-split line, and the text of each."""
        breaks = np.flatnonzero(self.data == 10)
        doc = self.doc_of(breaks)
        start = np.concatenate([self.offsets[:-1], breaks + 1])
        end = np.concatenate([self.offsets[1:], breaks])
        owner = np.concatenate([np.arange(self.n), doc])
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        order = np.lexsort((end, np.concatenate([np.arange(self.n), doc])))
        return start, end[order], owner


def windows(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` consecutive values within a text, and the index of its first value."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + values[k : k + n]
    room = np.zeros(len(values) + 1, np.int64)  # values left in the text from each index on
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths) - np.arange(len(values))
    room[: len(values)] = left
    at = np.flatnonzero(room[:n] >= width)
    return mix(h[at]), at


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` text bytes each, or one text if it is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def local_groups(column, met: dict[int, int]) -> np.ndarray:
    """Numbers 0, 1, ... for groups, in the order in which ``met`` first has them."""
    u, inverse = np.unique(column.to_numpy(), return_inverse=True)
    return np.array([met.setdefault(int(g), len(met)) for g in u], np.int64)[inverse]


def first_in_group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys, and a mark at the first of each run of equal keys in that order."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, new


def order_in_cells(cell: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Order by (cell, key); cells are small whole numbers, which a radix sort takes in linear time."""
    o = np.argsort(keys)
    c = cell[o]
    if len(c) and c.max() < 1 << 16:
        c = c.astype(np.uint16)
    return o[np.argsort(c, kind="stable")]
