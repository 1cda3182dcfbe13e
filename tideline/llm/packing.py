"""Packing documents into sequences by non-negative least squares.

Documents are cut into windows of the sequence length and one rest. The counts
of rests by length make a histogram of at most 2048 numbers, whatever the size of
the corpus. Shallow combinations of lengths that fill a window exactly are the
columns of a matrix; non-negative least squares finds how often to repeat each so
that they use up the histogram; the counts are rounded down, and what remains is
packed greedily, largest first. The plan says for each length which ranks go
where, so that each piece finds its sequence from its rank among its length's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.pieces import BYTE_CHARS, Pieces, split, unusual
from tideline.llm.ranking import parts_for, ranked
from tideline.llm.storage import narrow_batches, stored
from tideline.llm.words import blocks

WINDOW = 2048
END_ID = 1
#: Sweeps of the least-squares solver, and combinations of three tried for each length.
SWEEPS, TRIPLES = 60, 6


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The library's tokenizer, and a table of pieces filled from it."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    model = library.model

    def encode(pieces: list[bytes]) -> tuple[list[list[int]], list[str]]:
        return [[t.id for t in model.tokenize(p.decode("latin-1").translate(BYTE_CHARS))] for p in pieces], []

    return library, Pieces(encode)


def token_ids(path: str, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text, as the library's encode(text, add_special_tokens=False) gives them."""
    library, table = _encoder(path)
    for b in blocks(column):
        odd = unusual(b, (0xC3, 0xC4, 0xC5))
        start, end = split(b, b.data, True)
        piece_doc = np.searchsorted(b.offsets, start, side="right") - 1
        plain = ~odd[piece_doc]
        start, end, piece_doc = start[plain], end[plain], piece_doc[plain]
        rows = table.look_up(b, b.hashes(start, end), start, end, b.data)
        ids, counts = table.ids_of(rows)
        where = np.concatenate([[0], np.cumsum(np.bincount(piece_doc, counts, b.n).astype(np.int64))])
        for d in range(b.n):
            if odd[d]:
                text = b.data[b.offsets[d] : b.offsets[d + 1]].tobytes().decode("utf-8")
                yield b.first + d, np.array(library.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                yield b.first + d, ids[where[d] : where[d + 1]]


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece: whole windows, then the rest."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for row, ids in token_ids(path, batch.column(0)):
                ids = np.append(ids, END_ID).astype("<u4")
                out += [(row, s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window]), len(ids)) for s in range(0, len(ids), window)]
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(cols[:, 0])), *[pa.array(np.ascontiguousarray(cols[:, k])) for k in range(1, 5)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(have: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Lengths that fill a window exactly: one, two, or three of those that occur."""
    out: list[tuple[int, ...]] = [(window,)] if have[window] else []
    some = np.flatnonzero(have[:window])
    out += [(int(a), window - int(a)) for a in some if 2 * a <= window and have[window - a]]
    for a in some.tolist():
        others = some[(some >= a) & (2 * some <= window - a)]
        others = others[have[window - a - others] > 0]
        if len(others):
            # The commonest partners, as they can be repeated most often.
            weight = np.minimum(have[others], have[window - a - others])
            out += [(a, int(b), window - a - int(b)) for b in others[np.argsort(-weight, kind="stable")[:TRIPLES]]]
    return out


def repeat_counts(columns: list[tuple[int, ...]], have: np.ndarray) -> np.ndarray:
    """min |A x - have|, x >= 0, by coordinate descent: each step solves for one x, clipped at zero."""
    rest = have.astype(float)
    x = np.zeros(len(columns))
    cells = [(tuple(set(c)), [c.count(v) for v in set(c)], float(sum(c.count(v) ** 2 for v in set(c)))) for c in columns]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(cells):
            step = sum(rest[v] * t for v, t in zip(lengths, times, strict=True)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for v, t in zip(lengths, times, strict=True):
                    rest[v] -= step * t
        if moved < 0.25:
            break
    return x


def plan(have: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """have[l]: how many pieces of length l. Runs (length, first rank, end rank, first sequence, offset), and the number of sequences."""
    left = have.astype(np.int64).copy()
    used, runs, sequence = np.zeros_like(left), [], 0

    def take(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in parts:
            for _ in range(each):
                runs.append((length, int(used[length]), int(used[length]) + times, sequence, offset))
                used[length] += times
                left[length] -= times
                offset += length
        sequence += times

    columns = combinations(left, window)
    for c, x in zip(columns, repeat_counts(columns, left), strict=True):
        parts = [(v, c.count(v)) for v in sorted(set(c), reverse=True)]
        times = min([int(x), *[int(left[v]) // t for v, t in parts]])
        if times > 0:
            take(parts, times)
    while left.any():
        parts, gap, free = [], window, left.copy()
        while gap:
            fit = np.flatnonzero(free[: gap + 1])
            if not len(fit):
                break
            length = int(fit[-1])
            each = int(min(free[length], gap // length))
            parts.append((length, each))
            free[length] -= each
            gap -= each * length
        take(parts, max(1, min(int(left[v]) // t for v, t in parts)))
    return runs, sequence


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of docs.

    Null and empty texts have the one id END_ID. Rows are packed as they are, so
    repeated rows and ids give pieces of their own. An empty table gives none.
    Sequences hold no more than window ids; offsets in one run without gaps. Other
    columns are not looked at. A text of any length is encoded whole, its words in
    slices, and cut into as many pieces as it takes.
    """
    narrow_batches(docs.sparkSession)
    pieces = stored(cut(docs, path, id_col, text, window))
    have = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        have[r["length"]] = r["count"]
    runs, _ = plan(have, window)
    spark = docs.sparkSession
    by_length = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, since long, until long, sequence long, at long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("until", "since", "sequence", "at"))).alias("runs"))
    placed = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], "rank", parts_for(int(have.sum()))).join(F.broadcast(by_length), "length")
    run = F.filter("runs", lambda r: r["until"] > F.col("rank"))[0]
    return placed.withColumn("run", run).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("run.sequence") + F.col("rank") - F.col("run.since")).alias("sequence_id"), F.col("run.at").alias("offset"))
