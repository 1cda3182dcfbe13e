"""Toxicity behind a noisy channel.

A writer's word reaches us through a channel that swaps letters for look-alikes,
spaces letters out, joins words by characters that are no letters and repeats
characters. Every stretch of a text that may have passed it (a token that is not
plain letters or has a letter three times running, or a run of single characters
with gaps between) becomes a lattice of what each character may have been, with
optional borders of words. Plain letters are taken as they stand: two words joined
without anything between, or letters that are merely doubled, are not parted. Of a
longer run of one character four are kept. One Viterbi pass over the whole stretch,
under a character 4-gram model counted over the whole corpus and a prior for the
words that the classifier knows, decodes it. Nothing is looked up before: known
words are arcs of the same lattice and win by their score only. A classifier on
the restored words (and their beginnings, as stems inflect) then scores the text.

A stretch whose lattice holds no word or beginning that has a weight cannot change
a score; it is passed over, which a walk of the lattice along a trie of these tells
exactly. Tokens and runs may have any length: the time is linear in it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import narrow_batches, stored, with_fields
from tideline.llm.words import LOWER, blocks

#: Labelled rows that the classifier is fitted on: those with the smallest hashes of their ids. All else is over all rows.
TRAIN_ROWS = 12_000
#: Positive texts that a feature must occur in; how many features a classifier may have, of which cross-validation over FOLDS parts of the sample picks one.
LEAST_TEXTS, CHOICES, FOLDS = 3, (4, 8, 16, 32, 64, 128, 256, 512), 5
#: Beginnings of words that count as features.
STEMS = (4, 5, 6)
#: What a character may stand for, besides itself if it is a letter.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Log-probabilities of a swapped, a dropped and a repeated character.
SWAP, DROP, REPEAT = -1.0, -4.0, -0.5
#: Of a border of words inside a stretch, of none at a gap wider than usual, and of a word that the classifier knows.
BORDER, JOIN, KNOWN = -1.0, -2.0, -6.0
SYMBOLS, ORDER = 28, 4  # the border of a word, a to z, any other letter; characters of a gram
CONTEXTS = SYMBOLS ** (ORDER - 1)
_TAIL = SYMBOLS ** (ORDER - 2)
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27
_FOLD = str.maketrans("àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
_ONE = r"(?:[^\W_]|[@$!|+(€£¡])(?![^\W_])"
SPACED = re.compile(rf"(?<![^\W_]){_ONE}(?:[\s._\-*~]++{_ONE}){{2,}}")
GAP = re.compile(r"[\s._\-*~]+")
REPEATED = re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1{4,}")
#: Punctuation around a token: neither letters, digits nor look-alikes; and the usual ones of these.
_OUTER = rf"(?:[^\w{re.escape(''.join(LOOKS))}]|_)+"
OUTER = re.compile(rf"^{_OUTER}|{_OUTER}\Z")
USUAL = ".,;:?\"'`)]}[{<>=_-/\\#%&^~"
#: Words remembered in a task, features counted in it before they are passed on, and bytes of a text counted at once.
CACHE, COUNTED, SLICE = 20_000, 20_000, 1 << 20


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of ORDER characters in a row over every text: SYMBOLS ** ORDER numbers."""
    rows = docs.select(F.col(text).cast("string").alias("text"))
    size = SYMBOLS**ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                edges, last = b.offsets[1:-1], np.zeros(1, np.int32)
                for at in range(0, len(b.data), SLICE):  # one text may be far longer than a block
                    part = b.data[at : at + SLICE]
                    low = LOWER[part]
                    code = _CODE[low].astype(np.int32)
                    code[(low >= 0x80) & (low < 0xC0)] = -1  # one code for each letter
                    inner = edges[(edges >= at) & (edges < at + len(part))] - at
                    code = np.insert(code, inner, 0) if len(inner) else code  # texts do not run into each other
                    code = np.concatenate([last, code[code >= 0]])
                    code = code[np.concatenate([[True], (code[1:] > 0) | (code[:-1] > 0)])]
                    if len(code) >= ORDER:
                        gram = code[: len(code) - ORDER + 1].copy()
                        for k in range(1, ORDER):
                            gram = gram * SYMBOLS + code[k : len(code) - ORDER + 1 + k]
                        total += np.bincount(gram, minlength=size)
                    last = code[1 - ORDER :]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(size, np.int64)
    got = rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most SYMBOLS ** ORDER rows
    out[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | the three before), each order smoothed by the next shorter one; a row for each context."""
    c = counts.reshape((SYMBOLS,) * ORDER).astype(float)
    pair = c.sum(axis=tuple(range(ORDER - 2)))
    p = (pair + 0.5) / (pair.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    for k in range(3, ORDER + 1):
        part = c.sum(axis=tuple(range(ORDER - k)))
        p = (part + 4 * p[None]) / (part.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).reshape(CONTEXTS, SYMBOLS).astype(np.float32)


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


@dataclass
class Model:
    language: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def __post_init__(self):
        self.fresh()

    def __getstate__(self):
        return {"language": self.language, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.fresh()

    def fresh(self) -> None:
        """After a change of the weights: nothing is known of any word."""
        self.known: dict[str, tuple[str, ...]] = {}
        self.rows: dict[int, list[float]] = {}
        self.beginnings = {f.lstrip("=")[: STEMS[0]] for f in self.weights}
        # Tries of the words that the classifier knows (the word at the end), and of all features (True there).
        self.lexicon: dict = {}
        self.traces: dict = {}
        for f in self.weights:
            plain = f.lstrip("=").translate(_FOLD)
            for trie, end in ((self.traces, True), *([(self.lexicon, f[1:])] if f[0] == "=" else [])):
                for x in plain:
                    trie = trie.setdefault(x, {})
                trie.setdefault("", end)

    @staticmethod
    def lattice(chars: str) -> list[list[tuple[str, float]]]:
        """What each character may stand for ('' for nothing), and at what cost."""
        steps: list[list[tuple[str, float]]] = []
        before = ""
        for c in chars.translate(_FOLD):
            options = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKS.get(c, "")] + [("", DROP)] * (not c.isdigit())
            steps.append([*options, ("", REPEAT)] if c == before else options)
            before = c
        return steps

    def touched(self, steps: list[list[tuple[str, float]]]) -> bool:
        """Whether some reading of the lattice holds a feature, beginning anywhere."""
        live: dict[int, dict] = {}
        for options in steps:
            after: dict[int, dict] = {}
            for node in [self.traces, *live.values()]:
                for x, _ in options:
                    to = node.get(x) if x else node
                    if to is not None and to is not self.traces:
                        if "" in to:
                            return True
                        after[id(to)] = to
            live = after
        return False

    def known_from(self, steps: list[list[tuple[str, float]]], at: int) -> Iterator[tuple[int, str, float]]:
        """(step after it, word, cost) of each word of the classifier's that begins at a step."""
        live = {id(self.lexicon): (self.lexicon, 0.0)}
        for k in range(at, len(steps)):
            after: dict[int, tuple[dict, float]] = {}
            for node, cost in live.values():
                for x, more in steps[k]:
                    to = node.get(x) if x else node
                    if to is not None and (k > at or x) and (id(to) not in after or cost + more > after[id(to)][1]):
                        after[id(to)] = (to, cost + more)
            live = after
            if not live:
                return
            for node, cost in live.values():
                if "" in node:
                    yield k + 1, node[""], cost

    def decode(self, steps: list[list[tuple[str, float]]], border: list[float | None], join: list[float] | None = None) -> tuple[list[str], float]:
        """The likeliest words behind a lattice, and their score.

        border: the cost of a border of words before each step, None where there can
        be none; join: that of none. Between two words a step that can only be dropped
        costs nothing.
        """
        n = len(steps)
        join = join or [0.0] * n
        joined = [0.0]
        for j in join:
            joined.append(joined[-1] + j)
        rows, language = self.rows, self.language

        def p(context: int) -> list[float]:
            got = rows.get(context)
            if got is None:
                got = rows[context] = language[context].tolist()
            return got

        # Of the best words up to each border, and of each state of the word since: score and links back.
        ends: list[tuple | None] = [(0.0, None)] + [None] * n
        inside: dict[int, tuple] = {}

        def close(at: int, score: float, link: tuple) -> None:
            cost = 0.0 if at == n else border[at]
            if cost is not None and (ends[at] is None or score + cost > ends[at][0]):
                ends[at] = (score + cost, link)

        for i, options in enumerate(steps):
            before = [(c, s + join[i], since, letters) for c, (s, since, letters) in inside.items()]
            if ends[i] is not None:
                score, since = ends[i]
                if options[0][0] == "" and (ends[i + 1] is None or score > ends[i + 1][0]):
                    ends[i + 1] = ends[i]  # punctuation between two words is no part of either
                before.append((0, score, since, None))
                for j, word, cost in self.known_from(steps, i) if self.lexicon else ():
                    close(j, score + KNOWN + cost + joined[j] - joined[i + 1], (since, word))
            inside = {}
            for c, score, since, letters in before:
                row = p(c)
                for x, cost in options:
                    s, to = score + cost, c
                    if x:
                        z = _code(x)
                        s += row[z]
                        to = c % _TAIL * SYMBOLS + z
                    if to not in inside or s > inside[to][0]:
                        inside[to] = (s, since, (letters, x) if x else letters)
            best = None
            for c, (s, since, letters) in inside.items():
                if letters is not None and (best is None or s + p(c)[0] > best[0]):
                    best = (s + p(c)[0], since, letters)
            if best is not None:
                close(i + 1, best[0], best[1:])
        if ends[n] is None:
            return [], -math.inf
        out, link = [], ends[n][1]
        while link is not None:
            link, word = link
            if not isinstance(word, str):
                letters, parts = word, []
                while letters is not None:
                    letters, x = letters
                    parts.append(x)
                word = "".join(reversed(parts))
            out.append(word)
        return out[::-1], ends[n][0]

    def of_lattice(self, chars: str, border: list[float | None], join: list[float] | None, all_words: bool) -> list[str]:
        """The words of a stretch. One without a letter is a number or a rule unless the classifier knows its words."""
        steps = self.lattice(chars)
        if not all_words and not self.touched(steps):
            return []
        words, _ = self.decode(steps, border, join)
        return words if any(map(str.isalpha, chars)) else [w for w in words if "=" + w in self.weights]

    def of_run(self, run: str, all_words: bool = True) -> list[str]:
        """The words of a run of single characters."""
        chars, gaps = GAP.sub("", run), [len(g) for g in GAP.findall(run)]
        usual = min(gaps)
        # Of one character over and over four are enough: a word may end with two and the next begin with two.
        kept = [i for i in range(len(chars)) if i < 4 or chars[i] * 4 != chars[i - 4 : i]]
        wide = [i > 0 and gaps[i - 1] > usual for i in kept]
        return self.of_lattice("".join([chars[i] for i in kept]), [0.0 if w else BORDER for w in wide], [JOIN * w for w in wide], all_words)

    def of_token(self, raw: str, all_words: bool = True) -> list[str]:
        """The words of a token; borders can be anywhere but between two letters."""
        if not raw.isalpha():
            raw = OUTER.sub("", raw)
        if raw.isalpha() and not REPEATED.search(raw):
            return [raw]
        if not raw:
            return []
        raw = RUN.sub(r"\1\1\1\1", raw)
        # Punctuation that looks like no letter parts words at no cost.
        kind = [0 if c.isalpha() else 1 if c.isdigit() or c in LOOKS else 2 for c in raw]
        return self.of_lattice(raw, [None, *[0.0 if 2 in (a, b) else BORDER if a or b else None for a, b in zip(kind, kind[1:], strict=False)]], None, all_words)

    @staticmethod
    def of_word(word: str) -> tuple[str, ...]:
        return ("=" + word, *(word[:k] for k in STEMS if len(word) >= k)) if word else ()

    def features(self, text: str) -> set[str]:
        """All features of a text."""
        low = text.lower()
        words = {x for w in set(low.split()) for x in self.of_token(w)}
        words.update(w for run in set(SPACED.findall(low)) for w in self.of_run(run))
        return {f for w in words for f in self.of_word(w)}

    def hits(self, text: str) -> set[str]:
        """The features of a text that have a weight."""
        low = text.lower()
        out: set[str] = set()
        known, weights = self.known, self.weights
        words = set(low.split())
        words.update(" " + run for run in SPACED.findall(low))
        for w in words:
            if not w.isalpha() and w[0] != " ":
                w = w.strip(USUAL)
                if not w:
                    continue
            if w.isalpha() and w[: STEMS[0]] not in self.beginnings and not REPEATED.search(w):
                continue  # plain letters without a feature
            got = known.get(w)
            if got is None:
                got = tuple({f: 0 for x in (self.of_run(w[1:], False) if w[0] == " " else self.of_token(w, False)) for f in self.of_word(x) if f in weights})
                if len(known) > CACHE:
                    known.clear()
                known[w] = got
            if got:
                out.update(got)
        return out

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in self.hits(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the corpus (language) and at most TRAIN_ROWS labelled rows (weights).

    labels: (id, 0 or 1) rows to learn from; null labels are ignored, and an id
    labelled twice takes its largest. Without labels of both kinds no word has a
    weight and all scores are equal, near the share of label 1.
    """
    narrow_batches(docs.sparkSession)
    model = Model(log_model(gram_counts(docs, text)))
    kinds = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    sample = stored(kinds.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))
    # At most TRAIN_ROWS pairs of numbers are broadcast. Labels without a document do not count; a document that occurs twice does so twice.
    rows = stored(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_label", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("_fold")))
    totals = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy("_fold", "_label").agg(F.count("*").alias("n")).collect():  # a row for each fold and class
        totals[r["_fold"], int(r["_label"] > 0)] += r["n"]
    if not totals.sum(0).all():
        model.bias = 4.0 if totals[:, 1].any() else -4.0
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for t, y, f in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for x in model.features(t):
                    total.setdefault(x, [0] * (2 * FOLDS))[2 * f + int(y > 0)] += 1
                if len(total) > COUNTED:
                    yield counted(total)
                    total = {}
        yield counted(total)

    def counted(total: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.list_(pa.int64()))], names=["feature", "n"])

    sums = [F.sum(F.col("n")[k]) for k in range(2 * FOLDS)]
    found = stored(rows.mapInArrow(count, "feature string, n array<long>").groupBy("feature").agg(F.array(*sums).alias("n")).where(sum(F.col("n")[k] for k in range(1, 2 * FOLDS, 2)) >= LEAST_TEXTS))
    # Of all rows, and of all but each fold, the features that are most clearly commoner in positive texts.
    names = {out: clearest(found, totals, out) for out in (None, *range(FOLDS))}
    every = sorted({f for best in names.values() for f in best})
    model.weights = dict.fromkeys(every, 0.0)
    model.fresh()

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(model.hits(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.string())), *batch.columns[1:]], names=["hits", "label", "fold"])

    got = rows.mapInArrow(found_in, "hits array<string>, label int, fold int").groupBy("hits", "label", "fold").agg(F.count("*").alias("n")).collect()  # at most TRAIN_ROWS
    y, w, fold = (np.array([g(r) for r in got], float) for g in (lambda r: r["label"] > 0, lambda r: r["n"], lambda r: r["fold"]))
    losses: dict[int, np.ndarray] = {}
    for k in CHOICES:
        losses[k] = np.zeros(FOLDS)
        for out in range(FOLDS):
            train, held = fold != out, fold == out
            best = names[out][:k]
            theta = ridge(matrix(got, best)[train], y[train], w[train])
            z = matrix(got, best)[held] @ theta
            losses[k][out] = float((w[held] * np.logaddexp(0, np.where(y[held] > 0, -z, z))).sum()) / max(1.0, w[held].sum())
        if len(max(names.values(), key=len)) <= k:
            break
    # The fewest features whose mean loss is within a standard error of the least one's.
    least = min(losses.values(), key=np.mean)
    enough = least.mean() + least.std(ddof=1) / math.sqrt(FOLDS)
    chosen = names[None][: next(k for k, each in losses.items() if each.mean() <= enough)]
    theta = ridge(matrix(got, chosen), y, w)
    model.weights = {f: float(v) for f, v in zip(chosen, theta[:-1], strict=True)}
    model.bias = float(theta[-1])
    model.fresh()
    return model


def clearest(found: DataFrame, totals: np.ndarray, out: int | None) -> list[str]:
    """The CHOICES[-1] features whose share in positive texts is above that in others by most standard deviations, without the rows of fold out. Only the order counts, so the size of the sample doesn't."""
    folds = [f for f in range(FOLDS) if f != out]
    b, a = (float(max(1, totals[folds, k].sum())) for k in (0, 1))
    no, yes = (sum((F.col("n")[2 * f + k] for f in folds), F.lit(0)) for k in (0, 1))
    share = (yes + no) / F.lit(a + b)
    z = (yes / a - no / b) / F.greatest(F.sqrt(share * (1 - share) * (1 / a + 1 / b)), F.lit(1e-12))
    return [r["feature"] for r in found.withColumn("z", z).where("z > 0").orderBy(F.desc("z"), "feature").limit(CHOICES[-1]).collect()]


def matrix(rows: list, names: list[str]) -> np.ndarray:
    """Rows' hits among names as ones, and a column of ones."""
    where = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float64)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [where[f] for f in r["hits"] if f in where]] = 1
    return x


def ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's method; the last column's weight is the bias."""
    theta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.03)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (p - y)) + penalty * theta)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return theta


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (label 1 likelier when higher).

    Null and empty texts get the score of a text without any feature. A column
    of docs named like score is replaced; rows stay as they are, repeated ones too.
    Texts, tokens and runs of any length are decoded whole, in linear time. An empty
    table stays empty.
    """
    narrow_batches(docs.sparkSession)
    old = docs.select(*[f"`{c}`" for c in docs.columns if c != score])
    where = old.columns.index(text)
    schema = with_fields(old.schema, f"`{score}` double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(t or "") for t in batch.column(where).to_pylist()], pa.float64())], names=schema.names)

    return old.mapInArrow(run, schema)
