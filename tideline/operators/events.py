"""Event sampling and fractional differentiation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling, nullif0
from tideline.operators import recursions as R
from tideline.operators.buckets import numbered
from tideline.operators.indicators import in_blocks
from tideline.operators.scans import BLOCK, halos, speculative_scan, with_block, without_halos
from tideline.sources.shared import stored


def cusum_kernel(pdf: pd.DataFrame, state: np.ndarray | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        fired, states = R.cusum_run(np.log(pdf["close"].to_numpy(float)), pdf["_h"].to_numpy(float), state)
    return {"cusum_event": fired.astype(int)}, states


def cusum_features(bars: DataFrame, factor: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Event flag, bars since the event before, events in the last 100 bars; the threshold is last bar's deviation of returns times factor. In blocks, by speculation; the last event before a block is one row a block."""

    def threshold(df: DataFrame, r: Rolling) -> DataFrame:
        df = df.withColumn("_r", r.log_return(F.col("close"), 1))
        return df.withColumn("_s", r.std(F.col("_r"), 100, 50)).withColumn("_h", factor * r.lag(F.col("_s"))).drop("_r", "_s")

    rows = bars if "pos" in bars.columns else numbered(bars)
    source = stored(with_block(in_blocks(rows, 110, threshold, block), block))
    flagged = stored(speculative_scan(source, cusum_kernel, {"cusum_event": "int"}).drop("_block", "_h"))
    counted = in_blocks(flagged, 100, lambda df, r: df.withColumn("event_intensity_100", r.sum(F.col("cusum_event"), 100, 20)), block)
    return last_event(counted, block)


def last_event(df: DataFrame, block: int) -> DataFrame:
    """df with bars_since_event: how far the last event before a bar lies back."""
    at = F.when(F.col("cusum_event") == 1, F.col("pos"))
    rows = with_block(df, block)
    ends = rows.groupBy("symbol", "_block").agg(F.max(at).alias("_last"))
    came = F.max("_last").over(Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy("symbol", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_at", F.max(at).over(before)).join(ends.select("symbol", "_block", came.alias("_came")), ["symbol", "_block"])
    return found.withColumn("bars_since_event", F.col("pos") - F.coalesce("_at", "_came")).drop("_at", "_came", "_block")


def ffd_weights(d: float, least: float = 1e-4, most: int = 10_000) -> np.ndarray:
    """Binomial weights of (1 - B) ** d, oldest first, down to least in size."""
    w = [1.0]
    while len(w) < most:
        w.append(-w[-1] * (d - len(w) + 1) / len(w))
        if abs(w[-1]) < least:
            w.pop()
            break
    return np.array(w[::-1])


def frac_diff(x: np.ndarray, d: float, least: float = 1e-4) -> np.ndarray:
    """Fixed-width fractional difference: null until the window is full, and where a value in it is missing."""
    w = ffd_weights(d, least)
    out = np.full(len(x), np.nan)
    if len(x) >= len(w):
        out[len(w) - 1 :] = np.convolve(x, w[::-1], "valid")
        bad = np.convolve(np.isnan(x).astype(float), np.ones(len(w)), "valid") > 0.5
        if np.isnan(x).any():
            clean = np.convolve(np.nan_to_num(x), w[::-1], "valid")
            out[len(w) - 1 :] = np.where(bad, np.nan, clean)
    return out


def ffd_features(bars: DataFrame, ds: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5), least: float = 1e-4, block: int = BLOCK) -> DataFrame:
    """Fractional differences of the log price, raw and over their deviation of the last 200 bars; in blocks that look back as far as the weights reach."""
    names = {d: f"ffd_{str(d).replace('.', '')}" for d in ds}

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.log(pdf["close"].to_numpy(float))
        return {names[d]: frac_diff(x, d, least) for d in ds}

    rows = bars if "pos" in bars.columns else stored(numbered(bars))
    reach = max(len(ffd_weights(d, least)) for d in ds) - 1
    df = without_halos(R.per_symbol(halos(rows, reach, block), part, dict.fromkeys(names.values(), "double"), ["symbol", "_block"], "pos")).drop("_block")
    out = in_blocks(df, 200, lambda x, r: x.withColumns({f"{n}_z": F.col(n) / nullif0(r.std(F.col(n), 200, 50)) for n in names.values()}), block)
    return out if "pos" in bars.columns else out.drop("pos")


def adf_statistic(x: np.ndarray, lags: int = 1) -> float:
    """t value of the level in a regression of the difference on a constant, the level and lagged differences."""
    x = x[~np.isnan(x)]
    step = np.diff(x)
    y = step[lags:]
    design = np.column_stack([np.ones(len(y)), x[lags:-1], *[step[lags - k : len(step) - k] for k in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    error = y - design @ beta
    spread = error @ error / (len(y) - design.shape[1])
    cov = spread * np.linalg.pinv(design.T @ design)
    return float(beta[1] / math.sqrt(cov[1, 1]))


def adf_critical(n: int) -> float:
    """5 % critical value with a constant: MacKinnon's response surface (fixed values)."""
    return -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3


def least_ffd(bars: DataFrame, ds: tuple[float, ...] = tuple(i / 10 for i in range(11)), least: float = 1e-4, last: int = 20_000) -> DataFrame:
    """(symbol, d, statistic, critical, correlation, chosen): the smallest d whose difference is stationary is chosen. Symbols and ds run in parallel."""
    grid = bars.sparkSession.createDataFrame([(float(d),) for d in ds], "d double")
    ranked = bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_n") <= last)
    rows = ranked.select("symbol", "ts", "close").crossJoin(F.broadcast(grid))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.log(pdf["close"].to_numpy(float))
        d = float(pdf["d"].iloc[0])
        y = frac_diff(x, d, least)
        good = ~np.isnan(y) & np.isfinite(x)
        if good.sum() < 100:
            return pd.DataFrame({"symbol": [], "d": [], "statistic": [], "critical": [], "correlation": []})
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "d": [d], "statistic": [adf_statistic(y[good])], "critical": [adf_critical(int(good.sum()))], "correlation": [float(np.corrcoef(x[good], y[good])[0, 1])]})

    found = rows.groupBy("symbol", "d").applyInPandas(test, "symbol string, d double, statistic double, critical double, correlation double")
    first = F.min(F.when(F.col("statistic") < F.col("critical"), F.col("d"))).over(Window.partitionBy("symbol"))
    return found.withColumn("chosen", F.coalesce(F.col("d") == first, F.lit(False)))
