"""Spelling variant grouping: words one edit apart, found by errata tries, and the form each variant leads to.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, in which only A-Z are
lower-cased. A reading error is made on purpose: with h the CRC of
``<doc_id>:<run>``, a run whose h is a multiple of 97 loses its code point at
h modulo its length. What then has LEAST_LENGTH code points and LEAST_COUNT
occurrences in the corpus is a word.

**Groups.** Of two words one edit apart, the shorter of length a, either the first
a // 2 code points or the last a - a // 2 agree. So a word meets its neighbours in
four groups: for a its length and one less, by shared beginning and by shared end.
What lies between what a group shares is open. A group of over GROUP words is
parted again by halves of its open part, so a task holds a bounded number of words
at once; an open part of one code point has no more words than its alphabet allows.
A pair is looked for in one group only: by where it first differs.

**Errata trie.** The sorted open parts of a group are a trie: a node is a range with
a common beginning. At every branching node the child with most words is heavy;
each word of the light ones is merged into the node with one character skipped or
replaced: its rest joins the rests of the other light words, and is walked down
from the node and from the heavy child. Where terminals coincide the words are one
edit apart. A word is in a light subtree at most log2(words) times. Replacements
at one place are a set of words that are all near each other; such a set is only
counted and its two commonest looked at, so pairs are never written out.

Nulls: a null text has no words, a null id is written as nothing. Rows that repeat
an id each count. Empty tables give no rows, other columns aren't read. A very
long text is a block by itself; so is a very long run, which is a word like others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import narrow_batches, stored
from tideline.llm.words import LOWER, Block, blocks, ranges

LEAST_LENGTH = 5
LEAST_COUNT = 3
ERROR_IN = 97
#: Words of a group that a task holds at once.
GROUP = 2_048
#: Distinct words of a task that are held before they are passed on.
HELD = 1 << 19

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = LOWER[[*range(65, 91), *range(97, 123), 0xC3]]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32_of(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each carried on from a CRC. One step for all ranges at a time, up to 64; longer ones are left to zlib."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    c = ~before[order].astype(np.uint32)
    for j in range(min(64, int(left[0]) if len(left) else 0)):
        k = int(np.searchsorted(-left, -j, side="left"))  # ranges of more than j bytes
        c[:k] = _CRC[(c[:k] ^ data[at[:k] + j]) & np.uint32(0xFF)] ^ (c[:k] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = ~c
    for i in np.flatnonzero(length > 64).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def find_runs(b: Block) -> None:
    """The runs of letters of a block, lower-cased, as its words."""
    data = _LETTER[b.data]
    second = np.flatnonzero(b.data[:-1] == 0xC3) + 1
    data[second] = b.data[second]
    b.data = data
    b.find_words()


class Tally:
    """Words and how often they were met; passes on what it holds when that is much."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.full = 0, False

    def add(self, b: Block, h: np.ndarray, which: np.ndarray, counts: np.ndarray) -> None:
        """which: words of the block, h their hashes, counts how often each stands for."""
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        start, length = b.start[which[first]], (b.end - b.start)[which[first]]
        self.parts.append((keys, np.bincount(inverse, counts, len(keys)).astype(np.int64), length, b.data[ranges(start, length)]))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()
            self.full = self.size > HELD // 2

    def merge(self) -> None:
        h, n, length = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        data = np.concatenate([p[3] for p in self.parts])
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        starts = np.cumsum(length) - length
        self.parts = [(keys, np.bincount(inverse, n, len(keys)).astype(np.int64), length[first], data[ranges(starts[first], length[first])])]
        self.size = len(keys)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            _, n, length, data = self.parts[0]
            self.parts, self.size, self.full = [], 0, False
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([text.cast(pa.string()), pa.array(n)], ["word", "n"])


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, one_in: int = ERROR_IN) -> DataFrame:
    """(word, n): every word of at least least code points with its occurrences in parts of the corpus. Words are told apart in a task by 64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for b in blocks(batch.column(1)):
                find_runs(b)
                if not len(b.start):
                    continue
                h = b.word_hashes()
                # A run's error depends on document and run alone: each such pair is looked at once.
                _, which, times = np.unique(h + b.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
                heads = np.array([zlib.crc32(f"{ids[b.first + i] or ''}:".encode()) for i in range(b.n)], np.uint32)
                crc = crc32_of(heads[b.doc[which]], b.data, b.start[which], b.end[which])
                accents = np.concatenate([[0], np.cumsum(b.data == 0xC3)])
                size = (b.end - b.start - (accents[b.end] - accents[b.start]))[which]
                wrong = crc % one_in == 0
                sound = ~wrong & (size >= least)
                tally.add(b, h[which[sound]], which[sound], times[sound])
                changed: list[str] = []
                for k, c in zip(which[wrong & (size > least)].tolist(), crc[wrong & (size > least)].tolist(), strict=True):
                    run = b.data[b.start[k] : b.end[k]].tobytes().decode()
                    at = c % len(run)
                    changed.append(run[:at] + run[at + 1 :])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(changed, pa.string()), pa.array(times[wrong & (size > least)], pa.int64())], ["word", "n"])
                if tally.full:
                    yield from tally.taken()
        yield from tally.taken()

    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string")).mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words."""
    return occurrences(docs, doc_id, text).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def first_groups(words: DataFrame) -> DataFrame:
    """(a, pre, post, word, n): each word in its groups, a the length of a pair's shorter word."""
    size = F.length("word")
    sizes = words.withColumn("a", F.explode(F.when(size > F.lit(LEAST_LENGTH), F.array(size, size - 1)).otherwise(F.array(size))))
    return halves(sizes.withColumns({"pre": F.lit(""), "post": F.lit("")}))


def halves(rows: DataFrame) -> DataFrame:
    """Each row in two groups that share more: the first half of the open part, or the second."""
    rows = rows.withColumn("_r", F.expr("a - length(pre) - length(post)"))
    first = F.struct(F.expr("substring(word, 1, cast(length(pre) + _r div 2 as int))").alias("pre"), F.col("post").alias("post"))
    second = F.struct(F.col("pre").alias("pre"), F.expr("right(word, cast(length(post) + _r - _r div 2 as int))").alias("post"))
    return rows.withColumn("_g", F.explode(F.array(first, second))).select("a", "_g.pre", "_g.post", "word", "n")


def groups(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """Groups of at most limit words, or with an open part of one code point."""
    key, done = ["a", "pre", "post"], None
    rows = first_groups(words)
    while True:
        large = stored(rows.groupBy(*key).count().where(f"count > {limit} and a - length(pre) - length(post) > 1").select(*key))
        none = large.isEmpty()
        small = rows if none else rows.join(large, key, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        if none:
            return done
        rows = stored(halves(rows.join(large, key, "left_semi").select(*rows.columns)))


class Near:
    """Of each word of a group: how many near words were found, and the commonest (of those the first in order)."""

    def __init__(self, words: list[str], n: list[int]):
        self.order = [(-c, w) for w, c in zip(words, n, strict=True)]
        self.count = [0] * len(words)
        self.best: list[tuple[int, str] | None] = [None] * len(words)

    def link(self, i: int, j: int) -> None:
        for x, y in ((i, j), (j, i)):
            self.see(x, self.order[y], 1)

    def see(self, i: int, other: tuple[int, str], more: int) -> None:
        self.count[i] += more
        if self.best[i] is None or other < self.best[i]:
            self.best[i] = other

    def link_all(self, members: list[int]) -> None:
        """All of a set are near each other."""
        first, second = sorted(self.order[i] for i in members)[:2]
        for i in members:
            self.see(i, second if self.order[i] == first else first, len(members) - 1)


def common(a: str, b: str, at: int) -> int:
    """Length of the common beginning, known to be at least at."""
    top = min(len(a), len(b))
    if top - at > 64:  # halving first; long words
        low, high = at, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
        return low
    while at < top and a[at] == b[at]:
        at += 1
    return at


def errata(parts: list[str], shorter: int, ends: bool, near: Near) -> None:
    """Finds the pairs of parts, sorted and distinct, that are one edit apart: two of length shorter, or one of it and one longer by one.

    ends: pairs where the whole shorter part is the beginning of the longer are left to another group.
    """
    at = {p: i for i, p in enumerate(parts)}
    ahead = [(0, len(parts), 0)]
    while ahead:
        lo, hi, d = ahead.pop()
        d = common(parts[lo], parts[hi - 1], d)
        borders = [lo, *([lo + 1] if len(parts[lo]) == d else [])]
        while borders[-1] < hi:
            i = borders[-1]
            borders.append(bisect_left(parts, parts[i][:d] + chr(ord(parts[i][d]) + 1), i, hi))
        children = [*pairwise(borders)]
        heavy = max(children, key=lambda c: (c[1] - c[0], c[0]))
        ahead += [(a, b, d + 1) for a, b in children if b - a > 1]
        stem = parts[lo][:d]
        onward = parts[heavy[0]][: d + 1]  # the heavy child's path
        rests: dict[str, list[int]] = {}
        for child in children:
            if child == heavy:
                continue
            for i in range(*child):
                p = parts[i]
                rest = p[d + 1 :]
                if len(p) > shorter:
                    if rest and rest[0] != p[d] or not rest and not ends:  # its character skipped
                        j = at.get(stem + rest)
                        if j is not None:
                            near.link(i, j)
                    continue
                if len(p) > d:
                    rests.setdefault(rest, []).append(i)  # its character replaced
                if len(p) > d or not ends:
                    j = at.get(onward + p[d:])  # the heavy child's character skipped
                    if j is not None:
                        near.link(i, j)
        for rest, members in rests.items():
            j = at.get(onward + rest) if len(onward) > d else None
            members += [] if j is None else [j]
            if len(members) > 1:
                near.link_all(members)


def near_words(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near): of each word that has near words, their number and the commonest."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, int, str]] = []
        for (a, pre, post), rows in in_groups(batches):
            if len(rows) > 1:
                cut, end = len(pre), len(post)
                rows = sorted((w[cut : len(w) - end], w, n) for w, n in rows)
                near = Near([r[1] for r in rows], [r[2] for r in rows])
                errata([r[0] for r in rows], a - cut - end, bool(post), near)
                found += [(r[1], c, -b[0], b[1]) for r, c, b in zip(rows, near.count, near.best, strict=True) if c]
                if len(found) > 20_000:
                    yield made(found)
                    found = []
        if found:
            yield made(found)

    def made(found: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], ["word", "n_near", "near_n", "near"])

    key = ["a", "pre", "post"]
    dealt = groups(words, limit).repartition(*key).sortWithinPartitions(*key)
    parts = dealt.mapInArrow(search, "word string, n_near long, near_n long, near string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")).select("word", "n_near", (-F.col("b.m")).alias("near_n"), "b.near")


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str, str], list[tuple[str, int]]]]:
    """Rows (a, pre, post, word, n) that come by group, a group at a time."""
    now, rows = None, []
    for batch in batches:
        for a, pre, post, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, pre, post) != now:
                if rows:
                    yield now, rows
                now, rows = (a, pre, post), []
            rows.append((w, n))
    if rows:
        yield now, rows


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointers that double their reach. A form's n is at least twice its word's, so there are no circles and few rounds."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = stored(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if jumped.where("_moved").isEmpty():
            return now
        now = jumped.drop("_moved")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's commonest near word if that is at least twice as common, and the last of its forms."""
    narrow_batches(docs.sparkSession)
    words = stored(vocabulary(docs, doc_id, text))
    near = words.join(near_words(words, limit), "word", "left")
    led = F.col("near_n") >= 2 * F.col("n")
    rows = stored(near.select("word", F.when(led, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("near_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
