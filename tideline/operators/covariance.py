"""Covariance of two tapes that have no times in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling
from tideline.operators.buckets import WIDTH, carried, numbered, ticks
from tideline.operators.scans import BLOCK, halos, without_halos


def steps(series: DataFrame, key: str, value: str, block: int = BLOCK) -> DataFrame:
    """(key, _from, _to, _step): the change of value from each time to the next."""
    rows = numbered(series, key, "_t", width=WIDTH * 24)
    r = Rolling([key, "_block"], "pos")
    made = halos(rows, 1, block).withColumns({"_from": r.lag(F.col("_t")), "_step": r.diff(F.col(value))})
    return without_halos(made).where("_from is not null").select(key, "_from", F.col("_t").alias("_to"), "_step")


def hayashi_yoshida(x: DataFrame, y: DataFrame, value: str = "price", key: str = "symbol", ts: str = "ts", tie: str = "trade_id", width: float = WIDTH) -> DataFrame:
    """(key, n_x, n_y, covariance): the sum of products of changes of x and y over all pairs of their intervals that overlap.

    An interval of x from a to b overlaps the intervals of y from y's last time at or
    before a to its first time at or after b, so the changes of y over these add up
    to one difference of y: two as-of joins by buckets, no pairs of intervals. Where y
    has not begun at a, or has ended before b, its first or last value stands. Of rows
    at one time the last by tie counts; rows without value, time or key don't; keys
    that only one side has give no row, those without an interval a covariance of 0.
    """
    a, b = (df.where(F.col(value).isNotNull() & F.col(ts).isNotNull() & F.col(key).isNotNull()).select(key, ticks(df, ts).cast("double").alias("_t"), value, tie).groupBy(key, "_t").agg(F.max_by(value, tie).alias("_v")) for df in (x, y))
    ends = b.groupBy(key).agg(F.count("*").alias("n_y"), F.min_by("_v", "_t").alias("_first"), F.max_by("_v", "_t").alias("_last"))
    counts = a.groupBy(key).agg(F.count("*").alias("n_x")).join(ends, key)
    since = carried(steps(a, key, "_v"), b, F.struct(F.col("_v").alias("v")), key, "_from", "_t", width=width).select("_l.*", F.col("_r.v").alias("_since"))
    # The first time at or after b is the last one of time turned round.
    back = b.withColumn("_t", -F.col("_t"))
    until = carried(since.withColumn("_to", -F.col("_to")), back, F.struct(F.col("_v").alias("v")), key, "_to", "_t", width=width).select("_l.*", F.col("_r.v").alias("_until"))
    met = until.join(ends.select(key, "_first", "_last"), key)
    product = F.col("_step") * (F.coalesce("_until", "_last") - F.coalesce("_since", "_first"))
    return counts.join(met.groupBy(key).agg(F.sum(product).alias("covariance")), key, "left").select(key, "n_x", "n_y", F.coalesce("covariance", F.lit(0.0)).alias("covariance"))
