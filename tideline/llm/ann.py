"""Nearest neighbours by randomly rotated one-bit codes.

A vector is padded to WIDER times its length, rotated by one random orthogonal
matrix and kept as the signs of its coordinates, packed into 64-bit words, with
correction scalars: its length, and the inner product of its direction with its
code. A query is rotated alike and its coordinates are rounded to QUERY_BITS bits;
counting the bits that a code shares with each plane of these gives an unbiased
estimate of the inner product, with an error bound that holds with high
probability. Only vectors whose upper bound reaches the k-th best lower bound are
ranked again, by their original values in double precision.

Codes are made once. Queries and vectors meet in blocks of bounded size, each pair
of blocks once, and a pair hands on the k best of each query. Originals travel with
the codes of their block: fetching those of the survivors afterwards would move
every survivor of every query, which is more as soon as a query has some hundreds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.storage import stored

#: Components of a block's vectors (eight bytes each, besides the codes), and queries of a block.
BLOCK_COMPONENTS, BLOCK_QUERIES = 1 << 22, 8_192
#: Queries of a block when there are few: so that small tables use all cores.
LEAST_QUERIES = 256
#: Code bits of a dimension, and bits of a query's coordinate.
WIDER, QUERY_BITS = 8, 4
#: Bounds are this many standard deviations of the estimate wide.
DEVIATIONS = 3.0
SEED = 7


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """The first d rows of a random orthogonal matrix of the code's length: what padding and rotating comes to."""
    bits = -(-d * WIDER // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, d)))
    return (q * np.sign(np.diag(r))).T


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over a power of two so that their largest component is between 0.5 and 1, and that power: nothing over- or underflows later."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None]), power


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code words, length of the scaled vector, inner product of direction and code, power of two) of each row."""
    u, power = scaled(x)
    norm = np.linalg.norm(u, axis=1)
    y = (u / norm[:, None]) @ turn
    return packed(y > 0), norm, np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1]), power


def ones_of(codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes).sum(axis=0, dtype=np.int32)


def estimates(q: np.ndarray, turn: np.ndarray, codes: np.ndarray, ones: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of one query with coded vectors of the given lengths, and the half-width of their bounds.

    codes: a row for each word of the code, a column for each vector; ones: their ones.
    """
    bits = turn.shape[1]
    y = q @ turn
    low = float(y.min())
    step = (float(y.max()) - low) / (2**QUERY_BITS - 1) or 1.0
    level = np.rint((y - low) / step).astype(np.uint8)
    shared = np.zeros(codes.shape[1], np.int32)
    for bit in range(QUERY_BITS):
        plane = packed((level >> bit) & 1)
        shared += np.bitwise_count(codes & plane[:, None]).sum(axis=0, dtype=np.int32) << bit
    rounded = low + step * level
    inner = (2 * (low * ones + step * shared) - rounded.sum()) / np.sqrt(bits)
    scale = norm / fit
    spread = np.linalg.norm(q) * np.sqrt(np.maximum(1 - fit**2, 0)) / np.sqrt(max(bits - 1, 1)) + np.linalg.norm(y - rounded) / np.sqrt(bits)
    return inner * scale, DEVIATIONS * spread * scale


def best(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, power: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of this block for each query, by original values; ties to the smaller id, what is not a number last."""
    d, turn = x.shape[1], rotation(x.shape[1])
    columns = np.ascontiguousarray(codes.T)
    top = int(power.max())
    length = np.ldexp(norm, power - top)
    u, powers = scaled(q)
    ones = ones_of(columns)
    out = []
    for i in range(len(q)):
        guess, width = estimates(u[i], turn, columns, ones, length, fit)
        unit = int(powers[i]) + top
        # In doubles all that underflows is equal; what may overflow is infinite or no number at all, so it is always ranked again.
        least = np.ldexp(float(d), min(-1074 - unit, 1000))
        low, high = guess - width - least, guess + width + least
        risky = power + int(powers[i]) > 1022 - d.bit_length()
        low[risky], high[risky] = -np.inf, np.inf
        own = vec_id == query_id[i]
        low[own] = -np.inf
        kept = min(k, len(low))
        bar = np.partition(low, len(low) - kept)[len(low) - kept]
        near = np.flatnonzero((high >= bar) & ~own)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.cumsum(x[near] * q[i], axis=1)[:, -1]  # summed in order, as plain loops do
        order = np.lexsort((vec_id[near], -score))[:k]
        out.append((np.full(len(order), query_id[i]), vec_id[near][order], score[order]))
    if not out:
        return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def coded(rows: DataFrame) -> DataFrame:
    """(id, v, d, code, norm, fit, power) of (id, v) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == d))
                mine = lists.take(at)
                codes, norm, fit, power = encode(mine.flatten().to_numpy(zero_copy_only=False).reshape(-1, d), rotation(d))
                yield pa.RecordBatch.from_arrays([ids.take(at), mine, pa.array(np.full(len(at), d, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit), pa.array(power.astype(np.int32))], names=["id", "v", "d", "code", "norm", "fit", "power"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, d int, code binary, norm double, fit double, power int")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, its k nearest other rows.

    Nearness is the largest inner product in double precision, added up in order
    (so all products that underflow are equal, and terms that overflow make it
    infinite or no number), ties to the smaller id, what is no number last. Vectors that are null, empty, zero or hold
    null, NaN or infinite components take no part, nor do rows with a null id;
    vectors of different length are never compared. Repeated ids are rows like
    others, except that a query never finds its own id. Fewer than k candidates:
    all of them. An empty table gives none; other columns are not looked at. A
    neighbour is missed only where its estimate is off by over DEVIATIONS
    standard deviations.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    fine = stored(coded(fine))
    n, components = fine.agg(F.count("*"), F.coalesce(F.sum(F.col("d").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-components // BLOCK_COMPONENTS))
    asked = n // every
    query_blocks = max(1, -(-asked // BLOCK_QUERIES), min(-(-asked // LEAST_QUERIES), -(-spark.sparkContext.defaultParallelism // blocks)))
    left = fine.where(F.col("id") % every == 0).select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_block"), "id", "v")
    right = fine.select("d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"), F.col("id").alias("vec_id"), F.col("v").alias("x"), "code", "norm", "fit", "power")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        codes = np.frombuffer(b"".join(b["code"]), np.uint64).reshape(len(b), -1)
        return best(a["id"].to_numpy(), np.stack(a["v"].to_numpy()), b["vec_id"].to_numpy(), np.stack(b["x"].to_numpy()), codes, b["norm"].to_numpy(), b["fit"].to_numpy(), b["power"].to_numpy(), k)

    keys = ["d", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
