"""Quality rules on repetition.

Rolling hashes of several n-gram lengths, made for a block of texts at once in
numpy, measure which share of a text's characters lies inside duplicated n-grams
and duplicated lines. One narrow pass over the texts: no shuffle. Short n-grams
tell texts of stuttered words ("to to to to in in in in"), which hold no longer
n-gram twice; long ones tell repeated passages.

Shares are compared as integers, so a text exactly at a limit is kept. A text of
any length is measured whole, in memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.storage import narrow_batches, with_fields
from tideline.llm.words import Block, blocks, mix, ranges, windows

#: A text is repetitive if more than this percentage of its word characters lies in n-grams of n words that occur twice or more.
MAX_DUPLICATED = {2: 25, 3: 24, 4: 23, 5: 22, 6: 21, 7: 20, 8: 20, 9: 19, 10: 18}
#: ... or more than this in lines equal to an earlier line.
MAX_DUPLICATED_LINES = 20
#: The share rules need some text to be meaningful.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WORDS = 10, 20, 5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in MAX_DUPLICATED) + ", base_failed boolean, kept boolean"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def measure(b: Block) -> dict[str, np.ndarray]:
    b.find_words()
    salt = mix(np.arange(1, b.n + 1, dtype=np.uint64))
    points = (b.data & 0xC0) != 0x80  # the first byte of each code point
    chars = np.zeros(len(b.data) + 1, np.int32 if len(b.data) < 1 << 31 else np.int64)
    np.cumsum(points & b.inside, out=chars[1:])
    at = b.offsets
    out = {"n_words": b.n_words, "word_chars": (chars[at[1:]] - chars[at[:-1]]).astype(np.int64), "n_symbols": b.sums(SYMBOLS[b.data])}

    # Lines: parted by \n and by the texts' ends; those without a word do not count.
    breaks = np.flatnonzero(b.data == 10)
    line_start = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    line_doc = np.searchsorted(at[1:], line_start, side="right")
    line_doc = np.minimum(line_doc, b.n - 1)
    # A text that ends with \n has an empty last line; its start may be the next text's first byte, but it holds no word.
    line_end = np.minimum(np.append(line_start[1:], len(b.data)), at[1:][line_doc])
    line_end = np.where((line_end > line_start) & (b.data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(b.data) else line_end
    line_chars = chars[line_end] - chars[line_start]
    some = line_chars > 0
    line_start, line_end, line_doc, line_chars = line_start[some], line_end[some], line_doc[some], line_chars[some]
    later = _later(b.hashes(line_start, line_end) ^ salt[line_doc])
    count = lambda doc, weights=None: np.bincount(doc, weights, b.n).astype(np.int64)
    out |= {"n_lines": count(line_doc), "n_dup_lines": count(line_doc[later]), "dup_line_chars": count(line_doc[later], line_chars[later])}

    # n-grams: one of n + 1 words can occur twice only where that of n words does.
    h = b.word_hashes()
    word_chars = chars[b.end] - chars[b.start]
    places = np.arange(len(h))
    for n in MAX_DUPLICATED:
        all_n = windows(h, n)
        places = places[places < len(all_n)]
        places = places[b.doc[places] == b.doc[places + n - 1]]
        places = places[_repeated(all_n[places] ^ salt[b.doc[places]])]
        edge = np.bincount(places, minlength=len(h) + 1) - np.bincount(places + n, minlength=len(h) + 1)
        covered = np.cumsum(edge)[:-1] > 0
        if n == REPEAT_WORDS:
            out["n_repeat_words"] = count(b.doc[covered])
        out[f"dup_chars_{n}"] = count(b.doc[covered], word_chars[covered])
    n, chars_of = out["n_words"], np.maximum(out["word_chars"], 1)
    out["base_failed"] = (n < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    bad = 100 * out["dup_line_chars"] > MAX_DUPLICATED_LINES * chars_of
    for k, most in MAX_DUPLICATED.items():
        bad |= 100 * out[f"dup_chars_{k}"] > most * chars_of
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition(docs: DataFrame, text: str = "text", prefix: str = "", carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns named in carry) with the columns of SCHEMA.

    Null and empty texts: no words, base_failed, not kept. Columns of docs that
    clash with a new one are replaced (prefix avoids that); rows stay as they are,
    repeated ones too. An empty table stays empty.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    new = [prefix + x for x in names]
    narrow_batches(docs.sparkSession)
    carried = [c for c in (docs.columns if carry is None else carry) if c not in new]
    old = docs.select(*[f"`{c}`" for c in dict.fromkeys([text, *carried])])
    schema = with_fields(docs.select(*[f"`{c}`" for c in carried]).schema, ", ".join(prefix + x for x in SCHEMA.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                got = measure(b)
                rows = batch.select(carried).slice(b.first, b.n)
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(got[x]) for x in names]], names=[*rows.schema.names, *new])

    return old.mapInArrow(run, schema)
