"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a block go into a trie, in effect: sorted, each word shares
its longest common prefix with the one before, so walking them in order is the
depth-first traversal. A node's state is the last token of its prefix's encoding.
A child's last token is the one suffix of its prefix that is a token of the
vocabulary and that may follow the state of the node where it begins: two tokens
may stand side by side if merging their symbols anew gives just these two. An
encoding whose neighbours all fit is the one that the merges produce, so each
shared prefix is encoded once and a word's ids are read back along the states.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.pieces import BYTE_CHARS, Pieces, split, unusual
from tideline.llm.storage import narrow_batches, with_fields
from tideline.llm.words import LOWER, blocks

END = "</w>"


class Trie:
    """Encodes words (bytes) with the merges of a vocabulary whose last symbol of a word carries an end mark."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in BYTE_CHARS.items()}
        # Tokens by their bytes: those within a word, and those that end one.
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for token, i in vocab.items():
            ends = token.endswith(END) and len(token) > len(END)
            chars = token.removesuffix(END) if ends else token
            if chars and all(c in back for c in chars):
                (self.last if ends else self.inner)[bytes(back[c] for c in chars)] = i
                self.symbols[i] = tuple(vocab.get(c + (END if ends and k == len(chars) - 1 else ""), -1) for k, c in enumerate(chars))
        self.lengths = {i: len(s) for i, s in self.symbols.items()}
        self.inner_longest = max(map(len, self.inner))
        self.last_longest = max(map(len, self.last))
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """The merges applied in their order, each leftmost first."""
        out = list(symbols)
        while len(out) > 1:
            best = min(((self.rank.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(out, out[1:], strict=False))), key=lambda x: (x[0][0], x[1]))
            (rank, new), _ = best
            if rank == 1 << 60:
                break
            first, k, joined = self.pair_of(rank, new), 0, []
            while k < len(out):
                if k + 1 < len(out) and (out[k], out[k + 1]) == first:
                    joined.append(new)
                    k += 2
                else:
                    joined.append(out[k])
                    k += 1
            out = joined
        return out

    def pair_of(self, rank: int, new: int) -> tuple[int, int]:
        if not hasattr(self, "pairs"):
            self.pairs = {r: p for p, (r, _) in self.rank.items()}
        return self.pairs[rank]

    def is_whole(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.symbols[token]) == [token]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.is_whole(right) and self.merged(self.symbols[left] + self.symbols[right]) == [left, right]
        return known

    def step(self, word: bytes, end: int, states: list[int], tokens: dict[bytes, int], longest: int) -> int:
        """The last token of word[:end]; states[i] is that of word[: i + 1]."""
        fits, get = self.fits, tokens.get
        for k in range(1, min(end, longest) + 1):
            token = get(word[end - k : end])
            if token is None:
                continue
            if k == end:
                if self.is_whole(token):
                    return token
                continue
            left = states[end - k - 1]
            known = fits.get(left << 20 | token)
            if known if known is not None else self.may_follow(left, token):
                return token
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        states: list[int] = []
        before = b""
        for place in sorted(range(len(words)), key=words.__getitem__):
            word = words[place]
            n = len(word)
            shared, most = 0, min(len(before), n, len(states))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared:]
            before = word
            for end in range(len(states) + 1, n):
                states.append(self.step(word, end, states, self.inner, self.inner_longest))
            token = self.step(word, n, states, self.last, self.last_longest)
            ids, at = [token], n - self.lengths[token]
            while at:
                token = states[at - 1]
                ids.append(token)
                at -= self.lengths[token]
            out[place] = ids[::-1]
        return out


class Codec:
    """A vocabulary file's encoder and decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.trie = Trie(spec["model"]["vocab"], spec["model"]["merges"])
        self.string = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.control)) + ")") if self.control else None
        self.back = {c: b for b, c in BYTE_CHARS.items()}
        self.table = Pieces(self.encode_words)

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        ids = self.trie.encode(words)
        return ids, [" ".join([self.string[i] for i in x]) for x in ids]

    def encode_text(self, text: str) -> list[int]:
        """One text with the library's own splitting; its words by the trie."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.control:
                out.append(self.control[part])
            elif part:
                words = [bytes(self.back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                out += [i for ids in self.trie.encode([w for w in words if w]) for i in ids]
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: its tokens, parted by spaces."""
        return " ".join([self.string[i] for i in ids if i in self.string])

    def run(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, str]]:
        """(row, ids, decoded text) of each text."""
        for b in blocks(column):
            odd = unusual(b, (0xC3,))
            low = LOWER[b.data]
            accented = np.zeros(len(low), bool)
            accented[1:] = (b.data[:-1] == 0xC3) & (b.data[1:] >= 0x80) & (b.data[1:] <= 0x9E)
            low[accented] += 0x20
            start, end = split(b, low, False)
            doc = np.searchsorted(b.offsets, start, side="right") - 1
            plain = ~odd[doc]
            start, end, doc = start[plain], end[plain], doc[plain]
            b.text = low
            rows = self.table.look_up(b, b.hashes(start, end), start, end, low)
            ids, counts = self.table.ids_of(rows)
            where = np.concatenate([[0], np.cumsum(np.bincount(doc, counts, b.n).astype(np.int64))])
            words = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))])
            strings = self.table.strings
            all_rows = rows.tolist()
            for d in range(b.n):
                if odd[d]:
                    got = self.encode_text(b.data[b.offsets[d] : b.offsets[d + 1]].tobytes().decode("utf-8"))
                    yield b.first + d, np.array(got, np.int32), self.decode(got)
                else:
                    yield b.first + d, ids[where[d] : where[d + 1]], " ".join([strings[r] for r in all_rows[words[d] : words[d + 1]]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; with full also ids and decoded.

    Null and empty texts have no ids and decode to the empty text. Rows that
    repeat an id are returned once each; an empty table gives none; other columns
    are not looked at. A text of any length is encoded whole, in memory in proportion
    to it; one unbroken word takes time in proportion to its bytes.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).alias("doc_id"))
    schema = with_fields(rows.select("doc_id").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = codec(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, ids, decoded in engine.run(batch.column(0)):
                for column, v in zip(out, (row, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), ids if full else None, decoded if full else None), strict=True):
                    column.append(v)
            columns = [batch.column(1).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            if full:
                columns += [pa.array(out[4], pa.list_(pa.int32())), pa.array(out[5], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
