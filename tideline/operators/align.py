"""Aligning series: as-of, path and lookup joins, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.buckets import WIDTH, carried


def asof(left: DataFrame, right: DataFrame, values: list[str], key: str = "symbol", left_ts: str = "ts", right_ts: str = "ts", exact: bool = True, width: float = WIDTH) -> DataFrame:
    """left with the values of the last right row at or before (exact) each of its rows, per key.

    Dealt by key and bucket of width (seconds, or units of a plain number), so a key
    of any size runs in many tasks; see buckets.carried. Of right rows at one time
    the greatest values win.
    """
    found = carried(left, right, F.struct(*values), key, left_ts, right_ts, exact, width=width)
    return found.select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_next_day(hourly: DataFrame, daily: DataFrame, values: list[str], key: str = "symbol", date: str = "date", width: float = 30 * 86_400) -> DataFrame:
    """Daily values on hourly bars; a day's value is known from the next midnight on."""
    known = daily.withColumn("_at", (F.col(date).cast("timestamp_ntz") + F.expr("interval 1 day")))
    return asof(hourly, known, values, key=key, right_ts="_at", width=width)


def filled(df: DataFrame, columns: list[str], key: str = "symbol", order: str = "ts") -> DataFrame:
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in columns})


def left_many(base: DataFrame, others: list[DataFrame | None], on: list[str]) -> DataFrame:
    """base with the columns of each other frame; missing ones (None) are skipped."""
    for other in others:
        if other is not None:
            base = base.join(other, on, "left")
    return base


def side_by_side(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner equi-join; columns that both have get suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    named = [x.select(*[F.col(c).alias(c + s) if c in both else F.col(c) for c in x.columns]) for x, s in zip((a, b), suffixes, strict=True)]
    return named[0].join(named[1], on)


def forward_path(events: DataFrame, bars: DataFrame, n: int, key: str = "symbol", pos: str = "pos") -> DataFrame:
    """Each event with the n bars after it: an equi-join of exploded positions, with bar_no from 1. Bars that are missing are left out."""
    steps = events.withColumn("bar_no", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_pos", F.col(pos) + F.col("bar_no"))
    path = bars.select(F.col(key).alias("_key"), F.col(pos).alias("_at"), F.struct("ts", "open", "high", "low", "close").alias("bar"))
    return steps.join(path, (steps[key] == path["_key"]) & (steps["_pos"] == path["_at"])).drop("_key", "_at", "_pos")
