"""Ranked lexical search against brute force over every document and item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(UPPER))


def brute(docs, items, k=20):
    """docs: rows (id, text); items: {id: [texts]}."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_all = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for i, texts in items.items():
        asked, found = Counter(x for t in texts for x in terms(t)), []
        for d, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_all
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0 and d is not None:
                found.append((-s, d))
        out[i] = [(r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return {i: x for i, x in out.items() if x}


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "äpfel", "É", "日本語", "a_b", "x-y", "naïve"]
    docs = [(i * 3 % 1000, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(2_000 + i, "W1 w2 copy of one text") for i in range(90)]  # equal scores
    docs += [(5, None), (6, ""), (7, "?! ..."), (None, "w1 w2 w3"), (8, "w1 " * 3_000 + "tail " * 5_000), (9, "repeat w9"), (9, "repeat w9")]
    items = [(1, "w1 w2 copy"), (2, "w3 W3 äpfel É"), (3, None), (4, ""), (5, "nowhere"), (6, "tail naïve 日本語"), (6, "w7"), (7, " ".join(words)), (8, "repeat"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize(("cells", "item_terms"), [(1 << 24, 100_000), (16, 100_000), (2_000, 3)])
def test_search_equals_brute_force(spark, rows, monkeypatch, cells, item_terms):
    docs, items = rows
    monkeypatch.setattr(lexical, "CELLS", cells)
    table = spark.createDataFrame([(d, t, 1.0, 2, "x") for d, t in docs], "doc_id long, text string, score double, rank int, item_id string").repartition(5)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    whole = {}
    for i, t in items:
        if i is not None:
            whole.setdefault(i, []).append(t)
    assert got_of(lexical.ranked_search(table, asked, item_terms=item_terms)) == brute(docs, whole)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs.selectExpr("doc_id", "'. ,' as text"), items).count() == 0


def test_a_tree_opens_equal_bounds_and_skips_low_ones():
    rng = np.random.default_rng(3)
    for trial in range(30):
        n, width, k = int(rng.integers(1, 900)), 12, 5
        dense = rng.integers(0, 4, (n, width)) * (rng.random((n, width)) < 0.3)
        ids = rng.permutation(n)
        r, t = np.nonzero(dense)
        tree = lexical.MaxTree(ids, r, t, dense[r, t], width)
        asked = rng.choice(width, 4, replace=False)
        best: list = []
        opened = tree.search(asked, np.array([3, 2, 1, 1]), best, k)
        score = dense[:, asked] @ np.array([3, 2, 1, 1])
        want = sorted(((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s > 0))[:k]
        assert sorted((-s, -i) for s, i in best) == want
        assert opened <= sum(len(x) for x in tree.levels[1:])
    # One document far above the rest: all else stays closed.
    tree = lexical.MaxTree(np.arange(4096), np.arange(4096), np.zeros(4096, int), np.where(np.arange(4096) == 77, 100, 1), 1)
    best = []
    assert tree.search(np.array([0]), np.array([1]), best, 1) == 3 and best == [(100, -77)]


def test_impacts_are_exact_beyond_64_bits():
    tf, n = np.array([1, 5]), np.array([10**6, 10**3])
    got = lexical.impacts(tf, n, 10**13, 10**16)
    assert got.tolist() == [(10**9 * f) // (1000 * f + 12 * (75 + (25 * m * 10**13) // 10**16)) for f, m in zip(tf.tolist(), n.tolist(), strict=True)]
