"""Quality classifier: a byte-level convolutional network in numpy.

**Network.** Each byte of a text has CHANNELS - 1 learned numbers, and one that says
whether its last four bytes were met up to LAGS bytes before. FILTERS learned
filters of WIDTH bytes are applied at every second byte. A document's chunks of
CHUNK bytes overlap by WIDTH - 1 and cover all of it; a chunk's value for a filter
is the largest response in it, a document's are the largest and the mean of its
chunks', and a logistic unit makes one probability of these.

**Training.** Adam over STEPS batches of BATCH documents, in one task, on a bounded
sample: the labelled rows with the smallest hashes of their ids, at most TRAIN_ROWS
of them, and of those at most TRAIN_BYTES of text (a text that would go beyond is
left out). The gradient only visits the places where a filter was largest.

Scoring is one pass over whole texts. Nulls and empty texts are one chunk of
padding; NUL bytes count as padding. Labels that are null or without a document are
left out; without any label all scores are 0.5. Rows that repeat an id are scored
and learnt from alike. Other columns stay as they are. Empty tables give none. A
very long text is scored in slices of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import narrow_batches, with_fields
from tideline.llm.words import blocks

CHANNELS, WIDTH, FILTERS, CHUNK, STRIDE, LAGS = 5, 10, 16, 256, 2, 40
#: Zeros between two texts of a layout: no window and no lag passes them.
GAP = 48
TRAIN_ROWS, TRAIN_BYTES, STEPS, BATCH = 8_000, 48 << 20, 1_000, 32
RATE, DECAY = 0.006, 1e-5
#: Bytes whose windows are in memory at once: a multiple of CHUNK.
SLICE = 128 * CHUNK


@dataclass
class Model:
    """bytes: numbers of each byte; filters: (WIDTH * CHANNELS, FILTERS); unit: of the largest, then of the means."""

    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    unit: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.unit, self.shift]


def new_model(seed: int, share: float) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(draw(0.5, 256, CHANNELS - 1), draw((WIDTH * CHANNELS) ** -0.5, WIDTH * CHANNELS, FILTERS), np.zeros(FILTERS, np.float32), draw(0.1, 2 * FILTERS), np.array([np.log(share / (1 - share))], np.float32))


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with WIDTH zeros before it and filled with zeros to whole chunks, and the chunk that each begins with."""
    length = np.diff(offsets)
    n_chunks = -(-(length + GAP) // CHUNK)
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    out = np.zeros(int(first[-1]) * CHUNK, np.uint8)
    out[np.repeat(first[:-1] * CHUNK + WIDTH - offsets[:-1], length) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    return out, first


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the four bytes that end at a place also ended up to LAGS places before."""
    wide = data.astype(np.uint32)
    gram = wide.copy()
    for i in range(1, 4):
        gram[i:] |= wide[:-i] << np.uint32(8 * i)
    met = np.zeros(len(data), bool)
    for lag in range(1, min(LAGS, len(data) - 1) + 1):
        met[lag:] |= gram[lag:] == gram[:-lag]
    return (met & (data != 0)).astype(np.float32)


def channels(model: Model, data: np.ndarray, met: np.ndarray) -> np.ndarray:
    """(places + WIDTH, CHANNELS), the last ones of padding."""
    out = np.empty((len(data) + WIDTH, CHANNELS), np.float32)
    out[: len(data), :-1] = model.bytes[data]
    out[: len(data), -1] = met
    out[len(data) :, :-1] = model.bytes[0]
    out[len(data) :, -1] = 0
    return out


def pooled(model: Model, data: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest response, its place) of each chunk and filter, in slices of chunks."""
    largest, where = [], []
    for at in range(0, len(data), SLICE):
        # The windows of the last places look into the next slice.
        x = channels(model, data[at : at + SLICE + WIDTH], met[at : at + SLICE + WIDTH])
        n = min(SLICE, len(data) - at)
        windows = as_strided(x, (n // STRIDE, WIDTH * CHANNELS), (STRIDE * CHANNELS * 4, 4))
        y = (model.filters.T @ np.ascontiguousarray(windows).T).reshape(FILTERS, n // CHUNK, CHUNK // STRIDE)
        place = y.argmax(2)
        largest.append(np.take_along_axis(y, place[..., None], 2)[..., 0].T)
        where.append(at + np.arange(n // CHUNK)[:, None] * CHUNK + place.T * STRIDE)
    return np.maximum(np.concatenate(largest) + model.bias, 0), np.concatenate(where)


def combined(model: Model, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability, features) of each text from its chunks' values."""
    n = np.diff(first)[:, None]
    features = np.concatenate([np.maximum.reduceat(values, first[:-1]), np.add.reduceat(values, first[:-1]) / n], 1)
    z = features @ model.unit + model.shift[0]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50))), features


def gradients(model: Model, data: np.ndarray, met: np.ndarray, first: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, by the parts of the model."""
    values, where = pooled(model, data, met)
    p, features = combined(model, values, first)
    n = np.diff(first)
    dz = ((p - label) / len(label)).astype(np.float32)
    doc = np.repeat(np.arange(len(n)), n)
    dv = (dz / n)[doc, None] * model.unit[FILTERS:]
    # The largest of a text is that of the first chunk which has it.
    top = np.maximum.reduceat(values, first[:-1])[doc] == values
    rank = np.cumsum(top, 0)
    top &= rank - (rank[first[:-1]] - top[first[:-1]])[doc] == 1
    dv += top * dz[doc, None] * model.unit[:FILTERS]
    dv *= values > 0
    d_bytes, d_filters = np.zeros_like(model.bytes), np.empty_like(model.filters)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    repeated = np.concatenate([met, np.zeros(WIDTH, np.float32)])
    for f in range(FILTERS):
        some = np.flatnonzero(dv[:, f])
        c, at = dv[some, f], where[some, f][:, None] + np.arange(WIDTH)
        seen = padded[at]
        x = np.concatenate([model.bytes[seen], repeated[at][..., None]], 2).reshape(len(some), WIDTH * CHANNELS)
        d_filters[:, f] = c @ x
        weights = model.filters[:, f].reshape(WIDTH, CHANNELS)
        for k in range(CHANNELS - 1):
            d_bytes[:, k] += np.bincount(seen.ravel(), (c[:, None] * weights[:, k]).ravel(), 256).astype(np.float32)
    return [d_bytes, d_filters, dv.sum(0), dz @ features, dz.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam with a falling rate over batches of documents, each epoch in a new order."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = new_model(seed, share)
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data, first = layout(np.frombuffer(b"".join(texts), np.uint8), offsets)
    met = repeats(data)
    one, two = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order += rng.permutation(len(texts)).tolist()
        now, order = order[:BATCH], order[BATCH:]
        places = np.concatenate([np.arange(first[i] * CHUNK, first[i + 1] * CHUNK) for i in now])
        own = np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in now])])
        rate = RATE * (1 - (step - 1) / steps)
        for p, g, a, b in zip(model.parts(), gradients(model, data[places], met[places], own, labels[now]), one, two, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, steps: int = STEPS) -> Model | None:
    """The network trained on labelled documents; None without any. The sample's ids are bounded by rows, so they are broadcast."""
    narrow_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    sample = texts.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("h"), "_y", F.col("_t").cast("binary").alias("t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ys, left = [], [], size
        for batch in batches:
            for t, y in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) <= left:
                    kept.append(t)
                    ys.append(y)
                    left -= len(t)
        if kept:
            parts = train(kept, np.array(ys, np.float32), steps).parts()
            yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()), pa.array(range(len(parts)))], ["part", "k"])

    got = sample.repartition(1).sortWithinPartitions("h", "t", "_y").mapInArrow(learn, "part binary, k long").orderBy("k").collect()
    if not got:
        return None
    shapes = [p.shape for p in new_model(0, 0.5).parts()]
    return Model(*[np.frombuffer(r.part, np.float32).reshape(s) for r, s in zip(got, shapes, strict=True)])


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    laid, first = layout(data, offsets)
    return combined(model, pooled(model, laid, repeats(laid))[0], first)[0]


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the probability that a document's label is 1. A column of docs named like score is replaced."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))
    narrow_batches(docs.sparkSession)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != score])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scores(model, b.data, b.offsets) for b in blocks(batch.column(at).cast(pa.string()))]
            p = pa.array(np.concatenate([np.zeros(0), *made]))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, score])

    return docs.mapInArrow(run, with_fields(docs.schema, f"`{score}` double"))
