"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tideline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    n = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out, form = {}, {}
    for w in n:
        found = sorted((-n[x], x) for x in n if near(w, x))
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(found), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def got_of(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("limit", [3, 2_048])
def test_variants_equal_brute_force(spark, limit):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * rng.randint(1, 12)
        for _ in range(4):
            i, c = rng.randrange(len(s)), rng.choice("abÿß")
            words += [rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])] * rng.randint(1, 6)
    long = "ab" * 300
    words += [long] * 8 + [long + "a"] * 3 + [long[:200] + "x" + long[201:]] * 3 + ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["AAAAAAA"] * 3
    rng.shuffle(words)
    docs = [(i % 300, ", ".join(words[i::400]) + "-9") for i in range(400)]
    docs += [(None, "stress Stress STRESS ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ àéîõü"), (1, None), (2, ""), (3, "日本 12 . abaabœabaab")] + [(k, "hello " * 40) for k in range(500)]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    n = counted(docs)
    assert len(n) > 150 and any(len(w) == 599 or len(w) == 600 for w in n)
    assert got_of(spelling.variants(table, limit=limit)) == brute(n)
    assert got_of(spelling.variants(table.limit(0))) == {}


@pytest.mark.parametrize("limit", [2, 50])
def test_dense_words_are_all_linked(spark, limit):
    rng = random.Random(limit)
    n = {w: rng.randint(3, 60) for w in {"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(600)}}
    got = {r.word: (r.n_near, r.near_n, r.near) for r in spelling.near_words(spark.createDataFrame([*n.items()], "word string, n long"), limit).collect()}
    want = {}
    for w in n:
        found = sorted((-n[x], x) for x in n if near(w, x))
        if found:
            want[w] = (len(found), -found[0][0], found[0][1])
    assert got == want


def test_no_group_is_larger_than_asked(spark):
    words = spark.createDataFrame([("prefix" + "".join(random.Random(i).choices("abcdefgh", k=8)), 3) for i in range(500)], "word string, n long").distinct()
    sizes = spelling.groups(words, 20).groupBy("a", "pre", "post").count()
    assert sizes.where("count > 20 and a - length(pre) - length(post) > 1").count() == 0


def test_crc_of_ranges():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5_000).astype(np.uint8)
    start = np.sort(rng.integers(0, 4_000, 300))
    end = start + np.where(np.arange(300) % 50 == 0, 900, rng.integers(0, 70, 300))
    before = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    got = spelling.crc32_of(before, data, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]
