"""Bars: by time, on a grid without gaps, and by information."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import recursions as R
from tideline.operators.buckets import numbered
from tideline.operators.scans import BLOCK, speculative_scan, with_block
from tideline.operators.splits import running_sums
from tideline.sources.shared import stored

OHLCV = ("open", "high", "low", "close", "volume")


def floor_to(ts: str, unit: str) -> F.Column:
    """unit: hour, day, or a number of hours that divides a day, such as '4 hours'. TIMESTAMP_NTZ stays so."""
    if " " in unit:
        n = int(unit.split()[0])
        return (F.date_trunc("day", ts) + F.make_interval(hours=(F.floor(F.hour(ts) / n) * n).cast("int"))).cast("timestamp_ntz")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def time_bars(tape: DataFrame, unit: str = "hour") -> DataFrame:
    """One bar for each symbol and unit with trades; first and last by (ts, trade_id). One partial aggregation."""
    order = F.struct("ts", "trade_id")
    return tape.groupBy("symbol", floor_to("ts", unit).alias("ts_bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades")
    ).withColumnRenamed("ts_bar", "ts")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars; bins without bars inside a symbol's span have null prices and no volume."""
    bars = bars.withColumn("bin", floor_to("ts", unit))
    filled = bars.groupBy("symbol", "bin").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    step = {"hour": "1 hour", "day": "1 day"}.get(unit, unit)
    grid = filled.groupBy("symbol").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select("symbol", F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("bin"))
    return grid.join(filled, ["symbol", "bin"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumnRenamed("bin", "ts")


def positioned(bars: DataFrame) -> DataFrame:
    """bars with their place in their series, from 0."""
    return numbered(bars)


def gaps(bars: DataFrame, seconds: int = 3600) -> DataFrame:
    """Where two bars of a symbol are more than seconds apart."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    apart = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))
    return bars.withColumn("before", before).withColumn("seconds", apart).where(F.col("seconds") > seconds).select("symbol", F.col("before").alias("after_ts"), "ts", (F.col("seconds") / seconds - 1).cast("long").alias("missing"))


def fill_kernel(threshold: float):
    def run(pdf: pd.DataFrame, state: np.ndarray | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        closed, states = R.fill_run(pdf["m"].to_numpy(float), threshold, state)
        return {"_closed": closed.astype(np.int64)}, states

    return run


def info_bars(bars: DataFrame, threshold: float, kind: str = "volume", block: int = BLOCK) -> DataFrame:
    """Bars of equal volume or notional ('dollar'): a bar closes where the sum since the last close reaches threshold; what is left after the last close is no bar.

    The sum starts anew at each close, so blocks are run by speculation; the number
    of closes before a row is a running sum in blocks, and bars are one aggregation.
    """
    measure = F.col("volume") if kind == "volume" else F.col("close") * F.col("volume")
    numbers = bars if "pos" in bars.columns else numbered(bars)
    rows = stored(with_block(numbers.select("symbol", "ts", "pos", *OHLCV, measure.cast("double").alias("m")), block))
    marked = speculative_scan(rows, fill_kernel(threshold), {"_closed": "long"}).drop("_block")
    counted = running_sums(marked, {"_done": "_closed"}, ["pos"], block, "symbol").withColumn("bar_id", F.col("_done") - F.col("_closed"))
    return counted.groupBy("symbol", "bar_id").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("m").alias("measure"), F.count("*").alias("n_source_bars"), F.max("_closed").alias("_full")
    ).where("_full = 1").drop("_full")
