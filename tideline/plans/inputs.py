"""The engine's inputs as views of the star-schema tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling
from tideline.operators import bars as B
from tideline.sources import readers
from tideline.sources.shared import stored


def tape(spark: SparkSession, d: str) -> DataFrame:
    return readers.tape(readers.table(spark, d, "events"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(tape(spark, d), "hour")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(readers.order_tape(readers.table(spark, d, "orders")), "day")


def positioned(spark: SparkSession, d: str) -> DataFrame:
    """Bars with their places, written once: what follows reads them more than once."""
    return stored(B.positioned(hourly(spark, d)))


def funding(spark: SparkSession, d: str) -> DataFrame:
    """An eight-hourly series per symbol."""
    return tape(spark, d).groupBy("symbol", B.floor_to("ts", "8 hours").alias("fundingTime")).agg((F.avg("price") / 1e6).alias("fundingRate"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Bars of every symbol by position with their log returns, written once."""
    return stored(B.positioned(hourly(spark, d)).withColumn("logret", Rolling().log_return(F.col("close"), 1)))


def spans_to(bars: DataFrame, n: int, start: str = "start") -> DataFrame:
    """(symbol, start, end): a span from every bar to the n-th after it, or the last."""
    last = F.max("pos").over(Window.partitionBy("symbol"))
    return bars.select("symbol", F.col("pos").alias(start), F.least(F.col("pos") + n, last).alias("end"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums differ in their last digits between plans; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


TAPE = "tape AS (SELECT event_type AS symbol, ts, event_id AS trade_id, 100.0::DOUBLE + value AS price, 1.0::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, user_id % 2 = 0 AS is_buyer_maker FROM events)"
HOURLY = TAPE + """,
 hourly AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, sum(quantity) AS volume, count(*)::BIGINT AS trades FROM tape GROUP BY ALL),
 bars AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS pos FROM hourly)"""
DAILY = """daily AS (SELECT o_orderstatus AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume, count(*)::BIGINT AS trades FROM orders GROUP BY ALL)"""


def sql(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def rolling_sql(agg: str, x: str, w: int, least: int | None = None) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {w if least is None else least} THEN {agg}({x}) {over} END"


def ewm_sql(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive CTE of exponential averages; columns: out -> (value, alpha). Leading nulls stay null."""
    first = ", ".join(f"{x} AS {o}" for o, (x, _) in columns.items())
    step = ", ".join(f"CASE WHEN e.{o} IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN e.{o} ELSE {a!r} * s.{x} + (1 - {a!r}) * e.{o} END AS {o}" for o, (x, a) in columns.items())
    return f"{name} AS (SELECT symbol, pos, {first} FROM {source} WHERE pos = 0 UNION ALL SELECT s.symbol, s.pos, {step} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.pos = e.pos + 1)"
