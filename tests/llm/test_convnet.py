"""The byte-level network against plain loops, its gradient against differences, and what it learns."""

import random

import numpy as np
import pytest

from tideline.llm import convnet as C


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def some_model():
    model = C.new_model(5, 0.7)
    model.bias[:] = np.linspace(-0.4, 0.4, C.FILTERS)
    return model


def plain_score(model, text):
    """One text, filter by filter and place by place."""
    raw = list(text.encode())
    n_chunks = -(-(len(raw) + C.GAP) // C.CHUNK)
    padded = [0] * C.WIDTH + raw + [0] * (n_chunks * C.CHUNK - len(raw))
    grams = [tuple(padded[j] if j >= 0 else 0 for j in range(i - 3, i + 1)) for i in range(len(padded))]
    met = [float(padded[i] != 0 and any(grams[i] == grams[i - lag] for lag in range(1, C.LAGS + 1) if i >= lag)) for i in range(len(padded))]
    chunks = np.zeros((n_chunks, C.FILTERS))
    for c in range(n_chunks):
        for at in range(c * C.CHUNK, (c + 1) * C.CHUNK, C.STRIDE):
            x = np.concatenate([[*model.bytes[padded[j]], met[j]] for j in range(at, at + C.WIDTH)])
            chunks[c] = np.maximum(chunks[c], x @ model.filters + model.bias)
    z = np.concatenate([chunks.max(0), chunks.mean(0)]) @ model.unit + model.shift[0]
    return 1 / (1 + np.exp(-z))


TEXTS = ["", "a", "short text", "word word word word " * 20, "é日本 ### " * 60, "x" * 700, "a b\x00c d" * 9, "the end of " * 30]


def test_scores_equal_plain_loops():
    model = some_model()
    got = C.scores(model, *flat(TEXTS))
    assert np.allclose(got, [plain_score(model, t) for t in TEXTS], atol=1e-5)
    # Neighbours do not matter.
    assert np.allclose(got[::-1], C.scores(model, *flat(TEXTS[::-1])), atol=1e-6)


def test_slices_do_not_matter(monkeypatch):
    model, long = some_model(), "".join(random.Random(1).choices("abc ### ", k=20_000))
    whole = C.scores(model, *flat([long, "tail"]))
    monkeypatch.setattr(C, "SLICE", C.CHUNK)
    assert np.allclose(whole, C.scores(model, *flat([long, "tail"])), atol=1e-6)


def test_gradient_equals_differences():
    model = some_model()
    for p in model.parts():
        p += np.random.default_rng(1).standard_normal(p.shape).astype(np.float32) * 0.05
    wide = C.Model(*[p.astype(np.float32) for p in model.parts()])
    laid, first = C.layout(*flat(TEXTS))
    met, y = C.repeats(laid), np.array([1, 0, 1, 0, 0, 1, 1, 0], np.float32)

    def loss():
        p, _ = C.combined(wide, C.pooled(wide, laid, met)[0], first)
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    rng = np.random.default_rng(4)
    for p, g in zip(wide.parts(), C.gradients(wide, laid, met, first, y), strict=True):
        big = np.argsort(-np.abs(g).ravel())[:6]
        for i in rng.choice(big, min(4, len(big)), replace=False):
            at = np.unravel_index(i, p.shape)
            old, step = p[at], 1e-3
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.08, abs=3e-4)


def sentences(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    words = sentences(rng, n).split()
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[: n // 10 + 1] for _ in range(10))


def test_it_learns_junk_from_labels(spark):
    rng = random.Random(6)
    bad = [i % 5 == 0 for i in range(600)]
    texts = [(junk if b else sentences)(rng, rng.randint(8, 200)) for b in bad]
    docs = spark.createDataFrame([(i, t, "s", 2.0) for i, t in enumerate(texts)] + [(1000, None, None, None), (1001, "", None, None), (1002, "word and more, " * 20_000, None, None), (3, texts[3], None, None)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad) if i % 3] + [(4, None), (None, 1), (7_777, 0)], "doc_id long, quality int")
    model = C.fit(docs, labels, steps=300)
    out = C.scored(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score"] and out.count() == docs.count()
    got = {r.doc_id: r.score for r in out.collect()}
    held = [(got[i], b) for i, b in enumerate(bad) if i % 3 == 0]
    assert np.mean([(s >= 0.3) != b for s, b in held]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert C.scored(docs.limit(0), model).count() == 0
    # The sample is bounded by rows and by bytes; a text too long for it is left out.
    assert C.fit(docs, labels, rows=20, size=2_000, steps=5) is not None


def test_without_labels_all_scores_are_even(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert C.fit(docs, labels) is None
    assert {r.score for r in C.scored(docs, None).collect()} == {0.5}
