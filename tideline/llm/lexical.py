"""Ranked lexical search: every document against every query item, by max trees over ranges of documents.

Terms are maximal runs of ASCII letters and digits and of any characters beyond
ASCII, in which only A-Z are lower-cased. A document's score for an item sums,
over the item's terms with repeats, the term's weight times a saturated share of
its occurrences; all but the weight's logarithm is integer arithmetic.

Items are taken in blocks of about ITEM_TERMS terms. For a block, one pass over
the texts writes each document's length and its counts of the block's terms; a
second sums up document frequencies; in the third a task reads its documents in
ranges. A range is ordered by length, so that neighbours saturate alike, and has
for each term a tree of maxima with a fan of 16: leaves are what the term adds to
a document, and a node holds the largest of its children. An item's bound at a
node is the sum of its terms' maxima there. Nodes are opened from the highest
bound down; the search of a range ends when the highest bound is below the score
of the k-th document found, and a node of an equal bound is opened if it holds a
smaller id than that document. Scores found in one range bound the next ones.

Terms are compared by 64-bit hashes, and one occurrence of each term that a block
of texts meets also by its bytes. Nulls: a null text has no terms, so its document
counts nowhere; documents without an id count in all statistics and are never
listed; items of null or empty text have no rows. Rows that repeat a document id
are documents of their own, rows that repeat an item id are one item with the
terms of all, items without an id are left out. Empty tables give no rows. Other
columns aren't read. A very long text is a block by itself, an item of very many
terms a block of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.storage import narrow_batches, stored
from tideline.llm.words import LOWER, Block, blocks

FAN = 16
#: A range of documents has this many leaves over all terms of a block at most (four bytes each).
CELLS = 1 << 24
#: Term occurrences in a block of items, but for an item that has more by itself.
ITEM_TERMS = 100_000
#: Final ranks are taken in two steps, the first in so many parts of each item.
PARTS = 32

FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


class Terms:
    """The distinct terms of a block of items, by hash, and each item's terms with weights to come."""

    def __init__(self, items: dict[int, list[str]]):
        counts = {i: Counter(t for x in texts for t in terms_of(x)) for i, texts in items.items()}
        words = sorted({w for c in counts.values() for w in c})
        array = pa.array(words, pa.binary())
        hashes = np.concatenate([np.zeros(0, np.uint64), *(_found(b).word_hashes() for b in blocks(array))])
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [words[i] for i in order]
        at = {w: i for i, w in enumerate(self.words)}
        self.items = [(i, np.array([at[w] for w in c], np.int64), np.array([*c.values()], np.int64)) for i, c in counts.items() if c]

    def __len__(self) -> int:
        return len(self.words)


def _found(b: Block) -> Block:
    b.data = FOLD[b.data]
    b.find_words()
    return b


def terms_of(text: str | None) -> list[bytes]:
    return [bytes(b.data[s:e]) for b in blocks(pa.array([text], pa.string())) for b in [_found(b)] for s, e in zip(b.start, b.end, strict=True)]


def item_blocks(items: DataFrame, item_id: str, text: str, size: int = ITEM_TERMS) -> Iterator[Terms]:
    """The items in blocks; the driver holds one at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    held: dict[int, list[str]] = {}
    n = 0
    for i, t in rows.toLocalIterator():
        if i not in held and n >= size:
            yield Terms(held)
            held, n = {}, 0
        held.setdefault(i, []).append(t)
        n += len(t) // 4 + 1
    if held:
        yield Terms(held)


def postings(docs: DataFrame, terms: Terms, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many terms it has, which of the given ones, and how often."""
    hashes, words, width = terms.hashes, terms.words, max(1, len(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                _found(b)
                h = b.word_hashes()
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[place] == h)
                place = place[hit]
                met, first = np.unique(place, return_index=True)
                other = [t for t, k in zip(met.tolist(), hit[first].tolist(), strict=True) if bytes(b.data[b.start[k] : b.end[k]]) != words[t]]
                if other:
                    same = ~np.isin(place, other)
                    hit, place = hit[same], place[same]
                pairs, tf = np.unique(b.doc[hit] * width + place, return_counts=True)
                some = np.flatnonzero(b.n_words)
                ends = np.searchsorted(pairs, (some + 1) * width)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                ids = batch.column(0).slice(b.first, b.n).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(b.n_words[some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(pairs % width, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term: sums of one row for each task and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            total[:n_terms] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            total[n_terms:] += [batch.num_rows, int(batch.column(0).to_numpy().sum())]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["t", "c"])

    total = np.zeros(n_terms + 2, np.int64)
    for t, c in found.select("n", "terms").mapInArrow(count, "t int, c long").groupBy("t").agg(F.sum("c").alias("c")).collect():
        total[t] = c
    return int(total[-2]), int(total[-1]), total[:-2]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What a unit of weight adds, below 1,000,000; n is the document's length of each tf. Exact where the product passes 64 bits, too."""
    lengths = n if 25 * n_docs * int(n.max(initial=0)) < 1 << 63 else n.astype(object)
    m = 75 + np.asarray((25 * lengths * n_docs) // n_all, np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class MaxTree:
    """Maxima of every term over nested ranges of documents; level 0 has a row for each document."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        self.ids = ids
        level = np.zeros((-(-len(ids) // FAN) * FAN, n_terms), np.int32)
        level[rows, terms] = values
        low = np.full(len(level), np.iinfo(np.int64).max)
        low[: len(ids)] = ids
        self.levels, self.low = [level], [low]
        while len(level) > 1:
            short = -len(level) % FAN
            level = np.concatenate([level, np.zeros((short, n_terms), np.int32)]) if short else level
            low = np.concatenate([low, np.full(short, np.iinfo(np.int64).max)]) if short else low
            self.levels[-1], self.low[-1] = level, low
            level, low = level.reshape(-1, FAN, n_terms).max(1), low.reshape(-1, FAN).min(1)
            self.levels.append(level)
            self.low.append(low)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Takes the range's documents into best, a heap of the k best (score, -id) so far; gives how many nodes were opened."""
        opened, top = 0, len(self.levels) - 1
        ahead = [(-int(self.levels[top][0, terms].astype(np.int64) @ weights), int(self.low[top][0]), top, 0)]
        while ahead:
            bound, low, level, node = heapq.heappop(ahead)
            least = best[0] if len(best) == k else (0, 0)
            if -bound < max(1, least[0]):
                break
            if len(best) == k and (-bound, -low) < least:
                continue
            opened += 1
            a, below = node * FAN, level - 1
            bounds = self.levels[below][a : a + FAN][:, terms].astype(np.int64) @ weights
            for j in np.flatnonzero(bounds >= max(1, least[0])).tolist():
                if below:
                    heapq.heappush(ahead, (-int(bounds[j]), int(self.low[below][a + j]), below, a + j))
                else:
                    found = (int(bounds[j]), -int(self.ids[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
        return opened


def best_in_tasks(found: DataFrame, terms: Terms, n_docs: int, n_all: int, df: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each item among the documents of each task."""
    n_terms = len(terms)
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    items = [(i, t, w[t] * c) for i, t, c in terms.items]
    size = max(FAN, CELLS // max(1, n_terms))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[MaxTree]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield tree(held)
                    held, n = [], 0
        if held:
            yield tree(held)

    def tree(held: list[pa.RecordBatch]) -> MaxTree:
        whole = pa.Table.from_batches(held).combine_chunks().sort_by([("n", "ascending"), ("doc_id", "ascending")])
        ids, n, t, tf = (whole.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs"))
        sizes = t.value_lengths().to_numpy()
        rows = np.repeat(np.arange(len(ids)), sizes)
        return MaxTree(ids.to_numpy(), rows, t.flatten().to_numpy(), impacts(tf.flatten().to_numpy(), n.to_numpy()[rows], n_docs, n_all), n_terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for tree_ in trees(batches):
            for (_, t, ws), heap in zip(items, best, strict=True):
                tree_.search(t, ws, heap, k)
        rows = [(i, -d, s) for (i, _, _), heap in zip(items, best, strict=True) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item_id", "doc_id", "score"])

    return found.where("doc_id is not null").mapInArrow(search, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, equal scores by ascending id."""
    narrow_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for terms in item_blocks(items, item_id, item_text, item_terms):
        if not len(terms):
            continue
        found = stored(postings(docs, terms, doc_id, text))
        n_docs, n_all, df = statistics(found, len(terms))
        if n_docs:
            out = out.unionByName(best_in_tasks(found, terms, n_docs, n_all, df, k))
    order = [F.desc("score"), F.col("doc_id")]
    part = F.row_number().over(Window.partitionBy("item_id", F.pmod("doc_id", F.lit(PARTS))).orderBy(*order))
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return out.withColumn("rank", part).where(F.col("rank") <= k).withColumn("rank", last.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
