"""Pre-tokenisation of blocks of texts in numpy, and a table of encoded pieces.

Both vocabularies split a text at borders between letters, digits, white space
and the rest. For texts of ASCII and common accented Latin letters the borders
come from arrays of byte classes; any other text is left to the library itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tideline.llm.words import Block, ranges

LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte that is no printable character as one beyond 255, in order.
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Pieces kept in a process before it starts anew; a block with more distinct ones has a table of its own size, dropped after it.
KEPT = 400_000


def unusual(b: Block, leads: tuple[int, ...]) -> np.ndarray:
    """Texts that hold more than ASCII and letters of two bytes with these first bytes, or the start of a control token."""
    d = b.data
    if not len(d):
        return np.zeros(b.n, bool)
    odd = (d >= 0xC0) & ~np.isin(d, leads)
    follow = np.zeros_like(odd)
    follow[1:] = (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))  # the signs of multiplication and division
    odd |= follow
    odd[:-1] |= (d[:-1] == 60) & (d[1:] == 124)
    return b.sums(odd) > 0


def split(b: Block, text: np.ndarray, joins_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of a block starts and ends.

    joins_space: a space before a run of letters, digits or others belongs to it
    and white space makes pieces; else white space is left out and each digit is
    a piece.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = CLASS[text]
    edge = np.zeros(n, bool)
    inner = b.offsets[(b.offsets > 0) & (b.offsets < n)]
    edge[0] = True
    edge[inner] = True
    run = edge.copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    k, long = kind[starts], ends - starts
    at_edge = np.zeros(len(starts), bool)  # the text ends with this run
    at_edge[:-1] = edge[starts[1:]]
    at_edge[-1] = True
    first = np.zeros(n + 1, bool)
    spaced = np.zeros(len(starts), bool)  # a space before it belongs to it
    if joins_space:
        spaced = (starts > 0) & ~edge[starts] & (text[np.maximum(starts - 1, 0)] == 32) & (k != SPACE)
        first[starts[(k != SPACE) & ~spaced]] = True
        white = k == SPACE
        first[starts[white & (at_edge | (long > 1))]] = True
        first[ends[white & ~at_edge] - 1] = True
    else:
        first[starts[k != SPACE]] = True
        first[:n] |= kind == DIGIT
    # 's 't 're 've 'm 'll 'd
    quote = np.flatnonzero((k == OTHER) & (long == 1) & ~spaced & ~at_edge & (text[starts] == 39))
    quote = quote[k[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        at = starts[quote] + 1
        one, two = text[at], text[np.minimum(at + 1, n - 1)]
        has_two = long[quote + 1] > 1
        both = has_two & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        single = np.isin(one, (115, 116, 109, 100))
        size = np.where(single, 1, np.where(both, 2, 0))
        hit = size > 0
        at, size, after = at[hit], size[hit], ends[quote + 1][hit]
        first[at] = False
        rest = at + size
        first[rest[rest < after]] = True
    else:
        at = rest = quote
    start = np.flatnonzero(first[:n])
    stop = np.append(start[1:], n)
    if not joins_space:
        # A piece ends with its class's run or where the next one starts; a quote goes on into the letters.
        stop = np.minimum(stop, ends[np.searchsorted(starts, start, side="right") - 1])
        stop[np.searchsorted(start, at - 1)] = rest
    return start, stop


class Pieces:
    """Ids (and a string) of pieces by their 64-bit hash, in an open hash table: bounded, unless one block needs more."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[list[int]], list[str]]]):
        self.encode = encode
        self.clear()

    def clear(self, room: int = 0) -> None:
        """An empty table for KEPT pieces, or for room if that is more."""
        room = max(room, KEPT)
        slots = max(1 << 21, 1 << (4 * room - 1).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.rows = np.full(slots, -1, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.count, self.n = np.zeros(room, np.int64), np.zeros(room, np.int64), 0
        self.strings: list[str] = []

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        out = self.rows[slot].copy()
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.mask)
            got = self.rows[slot[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[slot[wrong]] != h[wrong])]
        return out

    def add(self, h: np.ndarray, pieces: list[bytes]) -> None:
        ids, strings = self.encode(pieces)
        keys, rows, mask = self.keys, self.rows, int(self.mask)
        flat = np.array([i for x in ids for i in x], np.int32)
        counts = np.array([len(x) for x in ids], np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(h)] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(h)] = counts
        self.used += len(flat)
        self.strings += strings
        for row, key in enumerate(h.tolist(), self.n):
            slot = key & mask
            while rows[slot] >= 0:
                slot = (slot + 1) & mask
            rows[slot], keys[slot] = row, key
        self.n += len(h)

    def look_up(self, b: Block, h: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The row of each piece; pieces not seen before are encoded."""
        found = self.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.argsort(h[new], kind="stable")]
            keep = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            order = order[keep]
            if self.n + len(order) > KEPT:
                self.clear()
                if len(order) < len(h):
                    every = np.argsort(h, kind="stable")
                    order = every[np.concatenate([[True], h[every][1:] != h[every][:-1]])]
                if len(order) > KEPT:
                    self.clear(len(order))
            raw = text.tobytes()
            for part in (order[k : k + KEPT] for k in range(0, len(order), KEPT)):
                self.add(h[part], [raw[s:e] for s, e in zip(start[part].tolist(), end[part].tolist(), strict=True)])
            found = self.find(h)
        return found

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces one after the other, and how many each has."""
        counts = self.count[rows]
        return self.ids[ranges(self.at[rows], counts)], counts
