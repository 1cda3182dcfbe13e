"""Words of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which on
UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``. Texts are handled in blocks of about
a megabyte so that a task's memory does not depend on the size of its batches;
one longer text makes a block of its own, whose marks take a few bytes for each of
its own and whose words some tens each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, as every block needs them."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, BLOCK_BYTES) + 2, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(begin - starts, lengths)


class Block:
    """Some whole texts: their bytes, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets.astype(np.int64), first
        self.n = len(offsets) - 1

    def find_words(self, lower: bool = False) -> None:
        """Sets start and end of each word, doc (its text) and word_offsets (of each text's words)."""
        self.text = LOWER[self.data] if lower else self.data
        inside = ~SEPARATOR[self.text]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.word_offsets = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.word_offsets)
        self.doc = np.repeat(np.arange(self.n), self.n_words)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, given in order: equal bytes, equal hashes, anywhere in the corpus.

        A long text is gone through in slices of ranges, so that the eight-byte sums
        are of a slice at a time.
        """
        if not len(self.data):
            return np.zeros(len(start), np.uint64)
        text = getattr(self, "text", self.data)
        if len(text) <= 2 * BLOCK_BYTES:
            return self._hashed(text, start, end)
        out, at = np.zeros(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK_BYTES)))
            low, high = int(start[at]), int(end[at:to].max())
            out[at:to] = self._hashed(text[low:high], start[at:to] - low, end[at:to] - low)
            at = to
        return out

    @staticmethod
    def _hashed(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * powers(_BASE, len(text))[: len(text)], out=total[1:])
        h = (total[end] - total[start]) * powers(_BASE_INVERSE, len(text))[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def sums(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n hashes in a row; the last n - 1 places have none."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out += h[i : i + m] * np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64))
    return mix(out)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column, null as empty, in blocks of about size bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, len(column))
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to
