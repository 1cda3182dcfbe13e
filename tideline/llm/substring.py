"""Substring deduplication over FM-indexes.

A word goes if a window of WINDOW words that covers it also starts in a document
with a smaller id. Every window holds an anchor: the one of its runs of ANCHOR
words with the smallest hash, so equal windows have equal anchors. Only anchors
that occur in different texts can hold such a window; the stretches of words
around them are what the indexes are made of and what is streamed against them.

Stretches go to shards by their anchor. A shard's distinct stretches are indexed:
their suffixes are sorted, and of these stay the Burrows-Wheeler transform, as a
wavelet matrix of packed bits, and the smallest documents of ranges of suffixes.
Each stretch is then streamed against the index: backward search gives for each of
its places the longest run of words up to there that an earlier document holds (its
matching statistic), and runs of WINDOW words and more are reported as intervals.

Before anything is shuffled to a shard, equals are made one: texts that are whole
copies count once, and so do equal stretches, of which the earliest document's is
the one that is indexed and streamed (in the others every word of it has occurred).
An anchor with over HOT distinct stretches would outgrow a shard; its stretches are
parted into their windows, which are made one likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import narrow_batches, release, scratch, stored, with_fields
from tideline.llm.words import Block, blocks, mix, windows

WINDOW, ANCHOR = 13, 4
#: Words of stretches in one shard's index, about; and stretches of one anchor beyond which it is keyed by windows.
SHARD_WORDS, HOT = 400_000, 2_000


def anchors_of(b: Block, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window places, anchor hash, anchor place): of each window the leftmost of its smallest runs."""
    h = b.word_hashes()
    grams = windows(h, size)
    inside = np.flatnonzero(b.doc[: max(0, len(h) - window + 1)] == b.doc[window - 1 :]) if len(h) >= window else np.zeros(0, np.int64)
    if not len(inside):
        return inside, np.zeros(0, np.uint64), inside
    width = window - size + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    best, at = grams[: len(view)].copy(), np.zeros(len(view), np.int64)
    for k in range(1, width):
        less = grams[k : k + len(view)] < best
        best[less] = grams[k : k + len(view)][less]
        at[less] = k
    return inside, best[inside], inside + at[inside]


def suffix_order(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Places of all suffixes, sorted, by prefix doubling; each 0 is a symbol of its own, so no comparison runs past one."""
    n, parts = len(codes), codes == 0
    rank = codes.astype(np.int64) + int(parts.sum())
    rank[parts] = np.arange(int(parts.sum()))
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else rank[:0]
        key = rank * (n + alphabet + 2) + after + 1
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1 or step >= n:
            return order
        step *= 2


class RangeMinimum:
    """The least of any range of an array: minima from and to the borders of blocks, and of runs of whole blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        n, size = len(values), self.BLOCK
        self.values = values.astype(np.int32)
        padded = np.full((-(-n // size), size), np.iinfo(np.int32).max, np.int32)
        padded.ravel()[:n] = self.values
        self.up_to = np.minimum.accumulate(padded, axis=1).ravel()
        self.on_from = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        self.runs = [padded.min(axis=1)]
        while 2 ** len(self.runs) <= len(padded):
            half = 2 ** (len(self.runs) - 1)
            self.runs.append(np.minimum(self.runs[-1][:-half], self.runs[-1][half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of ranges [lo, hi), none of them empty."""
        first, last = lo // self.BLOCK, (hi - 1) // self.BLOCK
        out = np.minimum(self.on_from[lo], self.up_to[hi - 1])
        between = np.flatnonzero(last - first > 1)
        if len(between):
            a, b = first[between] + 1, last[between]
            level = np.frexp(b - a)[1] - 1
            for k in np.unique(level):
                at = level == k
                i = between[at]
                out[i] = np.minimum(out[i], np.minimum(self.runs[k][a[at]], self.runs[k][b[at] - 2**k]))
        same = np.flatnonzero(first == last)
        if len(same):
            a, b = lo[same], hi[same]
            least = self.values[a]
            for k in range(1, int((b - a).max())):
                least = np.minimum(least, self.values[np.minimum(a + k, b - 1)])
            out[same] = least
        return out


class FMIndex:
    """Texts of word codes 1.. as the wavelet matrix of their Burrows-Wheeler transform, and whose each suffix is.

    Neither the texts nor the suffix array stay: a code takes its bits (and half as
    much for ranks), a suffix the smallest owner of ranges around it.
    """

    def __init__(self, codes: np.ndarray, owner: np.ndarray, alphabet: int):
        n, order = len(codes), suffix_order(codes, alphabet)
        self.n, self.owners = n, RangeMinimum(owner[order])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet + 1))])
        # The transform: for each bit of the codes a packed row, and ones up to each word of it.
        bwt = codes[order - 1]
        self.levels = max(1, int(alphabet).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        # Where each code's places begin on the last level.
        every = np.arange(alphabet + 1)
        self.first = self.descend(np.zeros(alphabet + 1, np.int64), every)

    def rank_one(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def descend(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = (code >> (self.levels - 1 - k)) & 1 == 1
            r = self.rank_one(k, at)
            at = np.where(one, self.zeros[k] + r, at - r)
        return at

    def step(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with code and go on as those of [lo, hi)."""
        both = self.descend(np.concatenate([lo, hi]), np.concatenate([code, code]))
        shift = self.before[code] - self.first[code]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def matching_statistics(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each place of a streamed text, how many words before its end also follow each other in a text of a smaller owner.

        codes: the streamed words; of a place the text begins at begin, the word
        before end is the last, and own is its owner. Backward search goes on for a
        place as long as its interval holds a smaller owner; at each step all places
        left go together.
        """
        length = np.zeros(len(end), np.int64)
        left = np.flatnonzero(end > begin)
        lo, hi = np.zeros(len(left), np.int64), np.full(len(left), self.n, np.int64)
        while len(left):
            lo, hi = self.step(lo, hi, codes[end[left] - 1 - length[left]])
            found = np.flatnonzero(hi > lo)
            found = found[self.owners.of(lo[found], hi[found]) < own[left[found]]]
            left, lo, hi = left[found], lo[found], hi[found]
            length[left] += 1
            more = end[left] - length[left] > begin[left]
            left, lo, hi = left[more], lo[more], hi[more]
        return length


def earlier_intervals(doc: np.ndarray, stretches: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each stretch (of the document at the same place) its intervals, of window words or more, that one of a smaller document holds.

    All stretches make the index; each is then streamed against it.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    if not len(sizes):
        return []
    flat = [w for s in stretches for w in s]
    code_of = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
    at = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int((sizes + 1).sum()), np.int64)
    words = np.ones(len(codes), bool)
    words[at + sizes] = False
    codes[words] = [code_of[w] for w in flat]
    _, dense = np.unique(doc, return_inverse=True)
    index = FMIndex(codes, np.repeat(dense, sizes + 1), len(code_of))
    # Only from the window-th word on can a statistic reach the threshold.
    per = np.maximum(sizes - window + 1, 0)
    of = np.repeat(np.arange(len(sizes)), per)
    end = at[of] + window + np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    length = index.matching_statistics(codes, at[of], end, dense[of])
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    hit = np.flatnonzero(length >= window)
    for k, e, m in zip(of[hit].tolist(), (end - at[of])[hit].tolist(), length[hit].tolist(), strict=True):
        mine = out[k]
        if mine and e - m <= mine[-1][1]:  # one grows out of the one before
            mine[-1] = (min(mine[-1][0], e - m), e)
        else:
            mine.append((e - m, e))
    return out


def covered(starts: list[int], ends: list[int], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(ends, np.int64), -1)
    return np.cumsum(edge)[:-1] > 0


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, whole, spans): which words of each document a window of an earlier one covers.

    spans are (start, end) word places, whole says that all words go because an
    earlier text has the same words. Documents without any are not returned.
    Tables of a step go from the shared folder as soon as the next one has its own.
    """
    narrow_batches(docs.sparkSession)
    size = min(ANCHOR, window)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).where("id is not null")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                b.find_words()
                h = b.word_hashes()
                place = (np.arange(len(h)) - b.word_offsets[b.doc]).astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
                total = np.zeros((2, len(h) + 1), np.uint64)
                for k in (0, 1):
                    np.cumsum(mix(h + (place + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])), out=total[k, 1:])
                digest = (total[:, b.word_offsets[1:]] - total[:, b.word_offsets[:-1]]).view(np.int64)
                where, anchor, at = anchors_of(b, window, size)
                keep = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                counts = np.bincount(b.doc[where[keep]], minlength=b.n) if len(where) else np.zeros(b.n, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(anchor[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(b.first, b.n), pa.array(b.n_words), pa.array(digest[0]), pa.array(digest[1]), lists], names=["id", "n_words", "da", "db", "anchors"])

    with scratch(docs.sparkSession) as keep:
        sketched = stored(rows.mapInArrow(sketch, "id long, n_words long, da long, db long, anchors array<long>"))
        text_key = ["da", "db", "n_words"]
        long_enough = sketched.where(F.col("n_words") >= window)
        firsts = stored(long_enough.groupBy(*text_key).agg(F.min("id").alias("first")))
        copies = stored(long_enough.select("id", *text_key).join(firsts, text_key).where("id > first").select("id").distinct())
        # Anchors of different texts; equal texts are one.
        each = long_enough.select("id", "da", F.explode("anchors").alias("anchor"))
        shared = stored(each.groupBy("anchor").agg(F.min("da").alias("a"), F.max("da").alias("b")).where("a <> b").select("anchor"))
        wanted = stored(each.select("id", "anchor").join(shared, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("wanted")).join(firsts.select(F.col("first").alias("id")), "id", "left_semi"))
        keep += [copies, wanted]
    release(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                b.find_words()
                where, anchor, at = anchors_of(b, window, size)
                if not len(where):
                    continue
                lists = batch.column(2).slice(b.first, b.n)
                mine = np.sort(mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(np.repeat(np.arange(1, b.n + 1, dtype=np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)))))
                key = mix(anchor ^ mix((b.doc[where] + 1).astype(np.uint64)))
                hit = mine[np.minimum(np.searchsorted(mine, key), len(mine) - 1)] == key if len(mine) else np.zeros(len(key), bool)
                where, anchor, at = where[hit], anchor[hit], at[hit]
                if not len(where):
                    continue
                # A stretch: consecutive windows with one anchor in one place.
                new = np.concatenate([[True], (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(where)) - 1
                s, e = where[first], where[last] + window
                raw = b.data.tobytes()
                ids = batch.column(1).slice(b.first, b.n).to_numpy(zero_copy_only=False)
                place = s - b.word_offsets[b.doc[s]]
                # A document's equal stretches are one row with all their places.
                found: dict[tuple[int, bytes], list[int]] = {}
                for k, (d, i, j) in enumerate(zip(b.doc[s].tolist(), s.tolist(), e.tolist(), strict=True)):
                    found.setdefault((d, b" ".join([raw[x:y] for x, y in zip(b.start[i:j].tolist(), b.end[i:j].tolist(), strict=True)])), []).append(k)
                one = np.array([at[0] for at in found.values()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[b.doc[s[one]]]), pa.array(anchor[first][one].view(np.int64)), pa.array([place[at].tolist() for at in found.values()], pa.list_(pa.int64())), pa.array((e - s)[one]), pa.array([w.decode("utf-8") for _, w in found], pa.string())],
                    names=["id", "anchor", "places", "words", "stretch"],
                )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, list[int], str]] = []
            for i, at, stretch in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = stretch.split(" ")
                out += [(i, [place + k for place in at], " ".join(words[k : k + window])) for k in range(len(words) - window + 1)]
            ids, places, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array([window] * len(ids), pa.int64()), pa.array(texts, pa.string())], names=["id", "places", "words", "stretch"])

    with scratch(docs.sparkSession) as keep:
        stretches = stored(rows.join(wanted, "id").select("text", "id", "wanted").mapInArrow(cut, "id long, anchor long, places array<long>, words long, stretch string"))
        release(docs.sparkSession)
        per_anchor = stretches.groupBy("anchor").agg(F.approx_count_distinct("stretch").alias("n")).where(F.col("n") > HOT)
        hot = stored(per_anchor.select("anchor"))
        # Classes of equal stretches: of these only the earliest document's is searched for, and what is found holds at all its places there; in the others every window has occurred.
        usual = stretches.join(hot, "anchor", "left_anti").select("id", "places", "words", "stretch", "anchor", F.lit(False).alias("hot"))
        cut_up = stretches.join(hot, "anchor", "left_semi").select("id", "places", "stretch").mapInArrow(single, "id long, places array<long>, words long, stretch string").withColumn("anchor", F.xxhash64("stretch")).withColumn("hot", F.lit(True))
        parts = stored(usual.unionByName(cut_up).withColumn("h1", F.xxhash64("stretch")).withColumn("h2", F.xxhash64("stretch", F.lit(1))))
        keep.append(parts)
    release(docs.sparkSession)
    key = ["h1", "h2", "hot"]
    classes = stored(parts.groupBy(*key).agg(F.min_by(F.struct("id", "places", "words", "anchor", "stretch"), F.struct("id", "places")).alias("own")).select(*key, "own.*"))
    release(docs.sparkSession)
    later = parts.select("id", "places", "words", *key).join(classes.select(*key, F.col("id").alias("owner")), key).where("id > owner").select("id", "words", F.explode("places").alias("start")).select("id", "start", (F.col("start") + F.col("words")).alias("end"))
    asked = classes.where("not hot")
    total = asked.agg(F.sum("words").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        got = earlier_intervals(pdf["id"].to_numpy(), [s.encode("utf-8").split(b" ") for s in pdf["stretch"]], window)
        out = [(i, int(p) + a, int(p) + b) for i, at, found in zip(pdf["id"], pdf["places"], got, strict=True) for a, b in found for p in at]
        return pd.DataFrame(out, columns=["id", "start", "end"]).astype("int64")

    found = asked.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(2)), F.lit(shards))).groupBy("shard").applyInPandas(search, "id long, start long, end long")
    spans = found.union(later).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = copies.select("id", F.lit(True).alias("whole"))
    return spans.join(whole, "id", "full").select("id", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, full: bool = False, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(carried columns, n_words, n_removed, kept_sha256) of each row.

    carry: columns of docs to return, by default the id. With full also text: as
    it was where nothing goes, else the kept words joined by a space. Null and
    empty texts have no words. Rows with a null id, and rows that repeat an id,
    are judged by what other ids hold (a null id matches nothing). A text of any
    length is taken whole, in memory in proportion to it. An empty table
    gives none. Carried columns that clash with a new one are replaced, which prefix
    (before the names of the new ones) avoids.
    """
    new = [prefix + c for c in ("n_words", "n_removed", "kept_sha256", *(["text"] if full else []))]
    carried = [c for c in ([id_col] if carry is None else carry) if c not in new]
    with scratch(docs.sparkSession) as keep:
        found = stored(duplicate_spans(docs, id_col, text, window))
        keep.append(found)
    release(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_own"), *[F.col(f"`{c}`").alias(f"_c_{c}") for c in carried])
    spans = found.select(F.col("id").alias("_id"), "whole", "spans")
    rows = rows.join(spans, F.col("_own") == F.col("_id"), "left").select("_text", F.coalesce("whole", F.lit(False)).alias("_whole"), F.col("spans.start").alias("_starts"), F.col("spans.end").alias("_ends"), *[f"`_c_{c}`" for c in carried])
    schema = with_fields(docs.select(*[f"`{c}`" for c in carried]).schema, ", ".join(f"`{c}` {kind}" for c, kind in zip(new, ("long", "long", "string", "string"), strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                rows = batch.slice(b.first, b.n)
                whole, starts, ends = (rows.column(k).to_pylist() for k in (1, 2, 3))
                counts, removed, shas, texts = [], [], [], []
                b.find_words()
                raw = b.data.tobytes()
                for d in range(b.n):
                    n = int(b.n_words[d])
                    gone = np.ones(n, bool) if whole[d] else covered(starts[d], ends[d], n) if starts[d] else np.zeros(n, bool)
                    s, e = (x[b.word_offsets[d] : b.word_offsets[d + 1]][~gone].tolist() for x in (b.start, b.end))
                    kept = b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])
                    counts.append(n)
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if full:
                        texts.append((kept if removed[-1] else raw[b.offsets[d] : b.offsets[d + 1]]).decode("utf-8"))
                made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), *([pa.array(texts, pa.string())] if full else [])]
                yield pa.RecordBatch.from_arrays([*rows.columns[4:], *made], names=schema.names)

    return rows.mapInArrow(run, schema)
