"""Causal indicators and the full feature frame, in blocks of positions.

Bars are numbered in their series. Exponential averages are affine scans, Supertrend
a speculative one; windows look back into a halo of the block before. No task holds
a series, and no exchange is by symbol alone but for a row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling, nullif0
from tideline.operators import recursions as R
from tideline.operators.bars import OHLCV, floor_to, resample
from tideline.operators.buckets import numbered
from tideline.operators.scans import BLOCK, affine_scan, halos, speculative_scan, with_block, without_halos
from tideline.sources.shared import stored

RETURNS = (1, 2, 3, 5, 10, 20, 50, 100, 200)
VOLS = (10, 20, 50, 100)
EMAS = (9, 20, 21, 50, 200)
HORIZONS = (1, 2, 3, 5, 10, 20, 50)
#: Bars that the longest window looks back on.
HALO = 220
RECURSIVE = (*[f"ema{s}" for s in EMAS], "rsi_14", "atr_14", "adx_14", "plus_di_14", "minus_di_14", "supertrend_trend", "supertrend_line")
#: Inputs of the averages of moves.
MOVES = ("_gain", "_loss", "_tr", "_pm", "_nm")


def in_blocks(bars: DataFrame, halo: int, make: Callable[[DataFrame, Rolling], DataFrame], block: int = BLOCK) -> DataFrame:
    """What make gives of bars and of functions over the last rows, block by block. Bars with pos are taken as numbered."""
    rows = bars if "pos" in bars.columns else numbered(bars)
    out = without_halos(make(halos(rows, halo, block), Rolling(["symbol", "_block"], "pos"))).drop("_block")
    return out if "pos" in bars.columns else out.drop("pos")


def with_moves(bars: DataFrame, block: int) -> DataFrame:
    """Bars by _block, with gains, losses, true ranges and directional moves. Bars without pos are numbered and written first, as scans read this twice."""

    def make(df: DataFrame, r: Rolling) -> DataFrame:
        h, low, c = (F.col(x) for x in ("high", "low", "close"))
        move, rise, fall, before = r.diff(c), r.diff(h), -r.diff(low), r.lag(c)
        return df.withColumns({
            "_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
            "_tr": F.greatest(h - low, F.abs(h - before), F.abs(low - before)),
            "_pm": F.when((rise > fall) & (rise > 0), rise).otherwise(0.0), "_nm": F.when((fall > rise) & (fall > 0), fall).otherwise(0.0),
        })

    rows = bars if "pos" in bars.columns else stored(numbered(bars))
    return with_block(in_blocks(rows, 1, make, block), block)


def averages(spans: tuple[int, ...]) -> dict[str, tuple[str, float, int]]:
    return {f"ema{s}": ("close", R.span_alpha(s), 1) for s in spans}


def wilder(out: str, value: str, n: int, gated: bool = True) -> dict[str, tuple[str, float, int]]:
    return {out: (value, 1.0 / n, n if gated else 1)}


STRENGTH = {**wilder("_ag", "_gain", 14), **wilder("_al", "_loss", 14), **wilder("atr_14", "_tr", 14)}


def rsi(gain: str = "_ag", loss: str = "_al") -> Column:
    """50 where there was no loss and before there are averages."""
    return F.coalesce(100 - 100 / (1 + F.col(gain) / nullif0(F.col(loss))), F.lit(50.0))


def directional(df: DataFrame) -> DataFrame:
    """ADX and its two sides, from averages of ranges and moves: a second scan over what the first gave. Missing values are 0."""
    width = nullif0(F.col("atr_14"))
    df = df.withColumns({"_up": 100 * F.col("_p") / width, "_down": 100 * F.col("_n") / width})
    dx = 100 * F.abs(F.col("_up") - F.col("_down")) / nullif0(F.col("_up") + F.col("_down"))
    scanned = affine_scan(df.withColumn("_dx", F.coalesce(dx, F.lit(0.0))), wilder("_adx", "_dx", 14))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scanned.withColumns({"adx_14": zero("_adx"), "plus_di_14": zero("_up"), "minus_di_14": zero("_down")}).drop("_adx", "_dx", "_up", "_down")


def bands_kernel(pdf: pd.DataFrame, state: np.ndarray | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    high, low, close, width = (pdf[c].to_numpy(float) for c in ("high", "low", "close", "atr_14"))
    trend, line, states = R.bands_run(high, low, close, width, state=state)
    return {"supertrend_trend": trend, "supertrend_line": line}, states


def recursive(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """bars with RECURSIVE: averages, RSI, ATR, ADX, Supertrend of the first kind."""
    out = _recursive(bars, block).drop("_block")
    return out if "pos" in bars.columns else out.drop("pos")


def _averaged(bars: DataFrame, block: int) -> DataFrame:
    return stored(affine_scan(with_moves(bars, block), {**averages(EMAS), **STRENGTH, **wilder("_p", "_pm", 14), **wilder("_n", "_nm", 14)}))


def _recursive(bars: DataFrame, block: int) -> DataFrame:
    one = _averaged(bars, block)
    df = speculative_scan(directional(one), bands_kernel, {"supertrend_trend": "double", "supertrend_line": "double"}, source=one)
    return df.withColumn("rsi_14", rsi()).drop(*MOVES, "_ag", "_al", "_p", "_n")


def strength(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """bars with averages, RSI, ATR and ADX: what affine scans give of RECURSIVE."""
    out = directional(_averaged(bars, block)).withColumn("rsi_14", rsi()).drop(*MOVES, "_ag", "_al", "_p", "_n", "_block")
    return out if "pos" in bars.columns else out.drop("pos")


def stochastic(df: DataFrame, value: str, n: int = 14, smooth_k: int = 3, smooth_d: int = 3, prefix: str = "stochrsi", r: Rolling | None = None) -> DataFrame:
    """StochRSI: 0 without a range or before there are n values; k is its running mean, d that of k, null until they have enough."""
    r = r or Rolling()
    x = F.col(value)
    low, high = r.min(x, n), r.max(x, n)
    df = df.withColumn("_s", F.coalesce((x - low) / nullif0(high - low), F.lit(0.0)) * 100)
    df = df.withColumn(f"{prefix}_k", r.mean(F.col("_s"), smooth_k))
    return df.withColumn(f"{prefix}_d", r.mean(F.col(f"{prefix}_k"), smooth_d)).drop("_s")


def higher_frame(bars: DataFrame, unit: str, tag: str, block: int = BLOCK) -> DataFrame:
    """(symbol, bin, features of the last completed coarser bar): an equi-join on the bin aligns it, as each bar lies in one bin."""
    c = F.col("close")
    scanned = affine_scan(with_moves(resample(bars, unit), block), {**averages((20,)), **STRENGTH})
    made = scanned.withColumns({"e": (c - F.col("ema20")) / c, "a": F.col("atr_14") / c, "r": rsi()}).drop("_block")
    names = {"e": "ema20_dist", "a": "atr_pct", "r": "rsi14", "l": "logret5"}

    def make(df: DataFrame, r: Rolling) -> DataFrame:
        df = df.withColumn("l", r.log_return(c, 5))
        return df.withColumns({f"htf_{tag}_{n}": r.lag(F.col(k)) for k, n in names.items()})

    return in_blocks(made, 6, make, block).select("symbol", F.col("ts").alias("bin"), *[f"htf_{tag}_{n}" for n in names.values()])


def volume_columns(r: Rolling, c: Column, v: Column) -> dict[str, Column]:
    return {"vol_z_50": r.zscore(v, 50), "vol_change_5": v / nullif0(r.mean(v, 5)) - 1}


def range_columns(r: Rolling, h: Column, low: Column, c: Column) -> dict[str, Column]:
    out = {"hl_range_pct": (h - low) / c, "close_pos_in_range": (c - low) / nullif0(h - low)}
    for w in (20, 50, 100):
        out |= {f"dist_from_high_{w}": (c - r.max(h, w)) / c, f"dist_from_low_{w}": (c - r.min(low, w)) / c}
    return out


def window_features(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every feature that needs no recursion."""
    return in_blocks(bars, HALO, windowed, block)


def windowed(bars: DataFrame, r: Rolling) -> DataFrame:
    _, h, low, c, v = (F.col(x) for x in OHLCV)
    base = bars.withColumns({"_r": r.log_return(c, 1), "_sv": F.coalesce(F.signum(r.diff(c)), F.lit(0.0)) * v})
    base = base.withColumn("_r1", r.lag(F.col("_r")))
    one = F.col("_r")
    mean, std = r.mean(c, 20), r.std(c, 20)
    made = {
        **{f"logret_{k}": r.log_return(c, k) for k in RETURNS},
        **{f"vol_{w}": r.std(one, w) for w in VOLS},
        "skew_50": r.skew(one, 50),
        "kurt_50": r.kurt(one, 50),
        "bb_pos": (c - mean) / nullif0(4 * std),
        "bb_width": 4 * std / mean,
        **volume_columns(r, c, v),
        # The change of a running sum over 20 bars is the sum of the last 20.
        "obv_slope_20": F.when(F.col("pos") >= 20, r.sum(F.col("_sv"), 20)) / nullif0(r.mean(v, 50)),
        **range_columns(r, h, low, c),
        "autocorr_20": r.autocorr(one, F.col("_r1"), 20),
        "hour_of_day": F.hour("ts"),
        "day_of_week": F.weekday("ts"),
    }
    return base.withColumns(made).drop("_r", "_r1", "_sv")


def features(bars: DataFrame, higher: bool = True, block: int = BLOCK) -> DataFrame:
    """The composite frame: one row a bar, null where a window isn't full. Batch and live use share it. Bars are made once and numbered once."""
    rows = bars if "pos" in bars.columns else stored(numbered(bars))
    c = F.col("close")

    def make(df: DataFrame, r: Rolling) -> DataFrame:
        df = windowed(stochastic(df, "rsi_14", r=r), r)
        width = nullif0(4 * F.col("atr_14"))
        return df.withColumns({
            "stochrsi_k_minus_d": F.col("stochrsi_k") - F.col("stochrsi_d"),
            "di_diff": F.col("plus_di_14") - F.col("minus_di_14"),
            "atr_pct_14": F.col("atr_14") / c,
            **{f"ema{s}_dist": (c - F.col(f"ema{s}")) / c for s in (9, 21, 50, 200)},
            **{f"ema{s}_slope_5": r.diff(F.col(f"ema{s}"), 5) / r.lag(F.col(f"ema{s}"), 5) for s in (9, 21, 50)},
            "keltner_pos": (c - F.col("ema20")) / width,
            "supertrend_dist": (c - F.col("supertrend_line")) / c,
        })

    df = in_blocks(recursive(rows, block), HALO, make, block)
    if higher:
        for unit, tag in (("4 hours", "4h"), ("day", "1d")):
            df = df.withColumn("bin", floor_to("ts", unit)).join(higher_frame(rows.drop("pos"), unit, tag, block), ["symbol", "bin"], "left").drop("bin")
    df = df.drop("atr_14", "supertrend_line", *[f"ema{s}" for s in EMAS])
    return df if "pos" in bars.columns else df.drop("pos")


def feature_names(df: DataFrame) -> list[str]:
    """Features by exclusion."""
    return [c for c in df.columns if c not in {"symbol", "ts", "pos", "trades", *OHLCV} and not c.startswith(("label_dir_", "fwdret_"))]


def lines_kernel(pdf: pd.DataFrame, state: np.ndarray | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Supertrend of the second and third kind, side by side."""
    args = [pdf[c].to_numpy(float) for c in ("high", "low", "close", "_w10")]
    line, a = R.line_run(*args, state=None if state is None else state[:3])
    switch, b = R.switch_run(*args, state=None if state is None else state[3:])
    return {"_line": line, "supertrend_v3": switch}, np.concatenate([a, b], axis=1)


def production_ratios(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """The small production set: ratios of averages, Keltner position of the second kind, distance to the second Supertrend; null before bar 60."""
    one = stored(affine_scan(with_moves(bars, block), {**averages((9, 20, 21, 50)), **wilder("_w", "_tr", 14, gated=False), **wilder("_w10", "_tr", 10, gated=False)}))
    df = speculative_scan(one, lines_kernel, {"_line": "double", "supertrend_v3": "double"})
    c, e = F.col("close"), {s: F.col(f"ema{s}") for s in (9, 20, 21, 50)}
    made = {
        "ema21_50_ratio": (e[21] - e[50]) / e[50],
        "ema9_21_ratio": (e[9] - e[21]) / e[21],
        "ema9_dist": (c - e[9]) / e[9],
        "keltner_pos_v2": (c - e[20] + 2 * F.col("_w")) / (4 * F.col("_w") + 1e-9),
        "supertrend_dist_v2": (c - F.col("_line")) / nullif0(F.col("_w")),
        "supertrend_v3": F.col("supertrend_v3"),
    }
    out = df.select(*[f.name for f in bars.schema.fields if f.name not in made], *(["pos"] if "pos" not in bars.columns else []), *[F.when(F.col("pos") >= 60, x).alias(n) for n, x in made.items()])
    return out if "pos" in bars.columns else out.drop("pos")


def keltner_v3(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keltner position of the third kind: bands of the 10-bar range."""
    df = affine_scan(with_moves(bars, block), {**averages((20,)), **wilder("_w10", "_tr", 10, gated=False)})
    out = df.withColumn("keltner_pos_v3", (F.col("close") - F.col("ema20") + 2 * F.col("_w10")) / nullif0(4 * F.col("_w10"))).drop(*MOVES, "ema20", "_w10", "_block")
    return out if "pos" in bars.columns else out.drop("pos")


def exponential(bars: DataFrame, columns: dict[str, tuple[str, float, int]], block: int = BLOCK) -> DataFrame:
    """bars with exponential averages (out -> (value, alpha, least values))."""
    rows = bars if "pos" in bars.columns else stored(numbered(bars))
    out = affine_scan(with_block(rows, block), columns).drop("_block")
    return out if "pos" in bars.columns else out.drop("pos")


def annual_vol(daily: DataFrame, w: int = 30, block: int = BLOCK) -> DataFrame:
    def make(df: DataFrame, r: Rolling) -> DataFrame:
        df = df.withColumn("_r", r.log_return(F.col("close"), 1))
        return df.withColumn("annual_vol", r.std(F.col("_r"), w) * (365**0.5) * 100).drop("_r")

    return in_blocks(daily, w + 1, make, block)


def regime_inputs(daily: DataFrame, block: int = BLOCK) -> DataFrame:
    """Daily inputs of the regime model: 3-day mean return, 14-day deviation, 10-day autocorrelation, ADX."""

    def make(df: DataFrame, r: Rolling) -> DataFrame:
        df = df.withColumn("_r", r.log_return(F.col("close"), 1)).withColumn("_r1", r.lag(F.col("_r")))
        return df.withColumns({"ret_3": r.mean(F.col("_r"), 3), "vol_14": r.std(F.col("_r"), 14), "autocorr_10": r.autocorr(F.col("_r"), F.col("_r1"), 10)}).drop("_r", "_r1")

    one = stored(affine_scan(with_moves(daily, block), {**wilder("atr_14", "_tr", 14), **wilder("_p", "_pm", 14), **wilder("_n", "_nm", 14)}))
    df = directional(one).withColumnRenamed("adx_14", "adx").drop(*MOVES, "_p", "_n", "atr_14", "plus_di_14", "minus_di_14", "_block")
    out = in_blocks(df, 20, make, block)
    return out if "pos" in daily.columns else out.drop("pos")
