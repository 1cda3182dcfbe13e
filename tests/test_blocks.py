"""Operators that run a series in blocks, against the same on the whole series."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import align, events, indicators, scans, splits
from tideline.operators import bars as B
from tideline.operators import recursions as R
from tideline.operators.buckets import numbered

T0 = datetime(2024, 1, 1)


def long_series(spark, n=700, seed=1, missing=()):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b", "c"):
        close = 100 + np.cumsum(rng.normal(size=n)) if s != "c" else 100 + np.arange(n) * 0.5  # c never turns
        for i, c in enumerate(close.tolist()):
            gap = s == "a" and i in missing
            rows.append((s, T0 + timedelta(hours=i), *([None] * 4 if gap else [c - 0.1, c + 1 + rng.random(), c - 1 - rng.random(), c]), float(1 + i % 7), i))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, pos long")


def one(df, s, *cols):
    return df.where(F.col("symbol") == s).orderBy("pos").select(*cols).toPandas()


@pytest.mark.parametrize("width", [1, 5, 3600])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_in_buckets_equals_a_scan(spark, width, exact):
    rng = np.random.default_rng(3)
    left = [(["k", "z", None][i % 3], int(t), i) for i, t in enumerate(rng.integers(0, 300, 200))] + [("k", None, 900), ("far", 10**6, 901)]
    right = [("k", int(t), float(v)) for t, v in zip(rng.integers(0, 90, 60), rng.random(60), strict=True)] + [("far", 1, 7.0), ("k", None, 99.0), (None, 3, 98.0), ("z", 250, None)]
    got = align.asof(spark.createDataFrame(left, "symbol string, ts long, n long"), spark.createDataFrame(right, "symbol string, ts long, v double"), ["v"], exact=exact, width=width)
    for r in got.collect():
        known = sorted((t, -1 if v is None else v, v) for k, t, v in right if k is not None and k == r.symbol and t is not None and r.ts is not None and (t <= r.ts if exact else t < r.ts))
        assert r.v == (known[-1][2] if known else None), r


def test_one_key_runs_in_many_tasks(spark):
    ticks = spark.range(5_000).select(F.lit("x").alias("symbol"), (F.timestamp_seconds(F.col("id") * 600)).cast("timestamp_ntz").alias("ts"), "id")
    joined = align.asof(ticks, ticks.where("id % 7 = 0").withColumnRenamed("id", "v"), ["v"])
    assert joined.where("v <> id - id % 7 or v is null").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("width", [1, 40])
def test_purge_by_series_equals_all_pairs(spark, width):
    rng = np.random.default_rng(5)
    train = [(s, int(a), int(a + d)) for s in "xyz" for a, d in zip(rng.integers(0, 400, 80), rng.integers(0, 30, 80), strict=True)] + [("x", 0, 100_000), ("y", 7, None), (None, 5, 9), ("x", 3, 3), ("x", 3, 3)]
    tests = [("x", 50, 60), ("x", 52, 53), ("y", 300, 300), ("x", 399, 2_000), ("z", 90_000, 90_001), ("y", None, 4), ("y", 20, None)]
    got = splits.purge(spark.createDataFrame(train, "s string, t0 long, t1 long"), spark.createDataFrame(tests, "s string, t0 long, t1 long"), key="s", width=width)
    hit = lambda k, a, b: k is not None and b is not None and any(k == s and c is not None and d is not None and a <= d and c <= b for s, c, d in tests)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.collect())) == order(r for r in train if not hit(*r))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    # Spans of one series do not touch another's.
    assert got.where("s = 'z'").count() == 80


def test_places_in_buckets(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([5, 1, 1, 9_999_999, 700, None])] + [("b", 3, 9), (None, 4, 10)], "symbol string, ts long, n int")
    got = {(r.symbol, r.n): r.pos for r in numbered(df, ties=("n",), width=100).collect()}
    assert got == {("a", 5): 0, ("a", 1): 1, ("a", 2): 2, ("a", 0): 3, ("a", 4): 4, ("a", 3): 5, ("b", 9): 0, (None, 10): 0}


def test_averages_in_blocks_with_gaps(spark):
    missing = {0, 1, 5, *range(60, 200), 333, *range(380, 384), 699}
    df = long_series(spark, missing=missing)
    for block in (64, 100):
        got = indicators.strength(df, block)
        for s in ("a", "b"):
            x = one(got, s, "high", "low", "close", "ema9", "ema200", "rsi_14", "atr_14", "adx_14", "plus_di_14")
            h, lo, c = (x[k].to_numpy(float) for k in ("high", "low", "close"))
            want = {"ema9": R.ewm(c, R.span_alpha(9)), "ema200": R.ewm(c, R.span_alpha(200)), "rsi_14": R.rsi(c, 14), "atr_14": R.wilder(R.true_range(h, lo, c), 14), "adx_14": R.adx(h, lo, c, 14)[0], "plus_di_14": R.adx(h, lo, c, 14)[1]}
            for k, v in want.items():
                assert np.allclose(x[k].to_numpy(float), v, rtol=1e-9, atol=1e-9, equal_nan=True), (s, k, block)


def test_maps_of_blocks_compose():
    rng = np.random.default_rng(2)
    for trial in range(40):
        x = np.where(rng.random(90) < rng.choice([0.05, 0.7]), np.nan, rng.normal(size=90))
        alpha, size = float(rng.choice([0.02, 0.3, 1.0])), int(rng.integers(1, 30))
        parts = [x[i : i + size] for i in range(0, 90, size)]
        starts = scans.composed(np.array([scans.ewm_map(p, alpha) for p in parts]), alpha)
        got = np.concatenate([scans.ewm_from(p, alpha, 3, s[0], int(s[1]), int(s[2])) for p, s in zip(parts, starts, strict=True)])
        assert np.allclose(got, R.ewm(x, alpha, 3), equal_nan=True, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("rounds", [1, 8])
def test_supertrend_and_cusum_in_blocks(spark, rounds):
    df = long_series(spark)
    averaged = scans.stored(scans.affine_scan(indicators.with_moves(df, 100), {**indicators.STRENGTH, **indicators.wilder("_w10", "_tr", 10, gated=False)}))
    got = scans.speculative_scan(averaged, indicators.bands_kernel, {"supertrend_trend": "double", "supertrend_line": "double"}, rounds=rounds, replayed="again")
    lines = scans.speculative_scan(averaged, indicators.lines_kernel, {"_line": "double", "supertrend_v3": "double"}, rounds=rounds)
    for s in "abc":
        x, y = one(got, s, "*"), one(lines, s, "*")
        h, lo, c = (x[k].to_numpy(float) for k in ("high", "low", "close"))
        trend, line = R.supertrend_bands(h, lo, c, R.wilder(R.true_range(h, lo, c), 14))
        assert (x["supertrend_trend"].to_numpy() == trend).all()
        assert np.allclose(x["supertrend_line"].to_numpy(float), line, equal_nan=True, rtol=1e-9)
        assert np.allclose(y["_line"].to_numpy(float), R.supertrend_line(h, lo, c), rtol=1e-9) and np.allclose(y["supertrend_v3"].to_numpy(float), R.supertrend_switch(h, lo, c), rtol=1e-9)
        assert (x["again"] <= 100).all() and (x["again"][:100] == 0).all()
    assert one(got, "a", "again")["again"].mean() < 80
    if rounds == 1:
        return
    fired = events.cusum_features(df, block=100)
    whole = events.cusum_features(df, block=10_000)
    for s in "abc":
        a, b = (one(t, s, "cusum_event", "bars_since_event", "event_intensity_100") for t in (fired, whole))
        pd.testing.assert_frame_equal(a, b)


def test_a_recursion_that_never_forgets(spark):
    """A plain sum keeps its start for ever, so each block waits for the one before it."""
    df = scans.stored(scans.with_block(long_series(spark, 300), 20))

    def total(pdf, state):
        out = (0.0 if state is None else state[0]) + pdf["volume"].to_numpy().cumsum()
        return {"total": out}, out[:, None]

    for rounds in (2,):
        x = one(scans.speculative_scan(df, total, {"total": "double"}, rounds=rounds), "b", "volume", "total")
        assert np.allclose(x["total"], x["volume"].cumsum())


@pytest.mark.parametrize("block", [7, 100, 4_096])
def test_information_bars_in_blocks(spark, block):
    df = long_series(spark, 300)
    for threshold in (20.0,) if block == 7 else (3.0, 20.0, 1_000.0, 10_000.0):
        got = {(r.symbol, r.bar_id): (r.n_source_bars, r.measure) for r in B.info_bars(df, threshold, block=block).collect()}
        want, volume = {}, [float(1 + i % 7) for i in range(300)]
        total, n, bar = 0.0, 0, 0
        for v in volume:
            total, n = total + v, n + 1
            if total >= threshold:
                want |= {(s, bar): (n, total) for s in "abc"}
                total, n, bar = 0.0, 0, bar + 1
        assert got == want


def test_windows_with_halos(spark):
    df = long_series(spark, 500, missing={77, 78, 300})
    x, y = (indicators.window_features(df, b).orderBy("symbol", "pos").toPandas() for b in (90, 10_000))
    pd.testing.assert_frame_equal(x, y, rtol=1e-9, atol=1e-12)
    plan = indicators.window_features(df, 90)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and ", _block" in plan and "hashpartitioning(symbol#" not in "".join(p.split("),")[0] for p in plan.split("Exchange ")[1:] if "_block" not in p.split("ENSURE")[0])
