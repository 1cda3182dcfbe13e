"""Trade flow, open interest, funding and basis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import nullif0
from tideline.operators.align import asof, left_many
from tideline.operators.indicators import in_blocks
from tideline.operators.bars import floor_to

LARGE = 1.0


def hourly_flow(tape: DataFrame, large: float = LARGE) -> DataFrame:
    """Taker volumes, notionals, counts, VWAP, last price and their ratios by hour: one partial aggregation."""
    buy, qty, notional = ~F.col("is_buyer_maker"), F.col("quantity"), F.col("price") * F.col("quantity")
    big = qty >= large
    some = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    flow = tape.groupBy("symbol", floor_to("ts", "hour").alias("hour")).agg(
        some(buy, qty).alias("taker_buy_vol"), some(~buy, qty).alias("taker_sell_vol"), some(buy, notional).alias("taker_buy_notional"), some(~buy, notional).alias("taker_sell_notional"),
        F.count("*").alias("trade_count"), F.sum(buy.cast("long")).alias("buy_trade_count"), some(buy & big, qty).alias("large_buy_vol"), some(~buy & big, qty).alias("large_sell_vol"),
        (F.sum(notional) / nullif0(F.sum(qty))).alias("vwap"), F.max_by("price", F.struct("ts", "trade_id")).alias("price_close"),
    )
    bought, sold = F.col("taker_buy_vol"), F.col("taker_sell_vol")
    flow = flow.withColumns({"net_taker_flow": bought - sold, "ofi": (bought - sold) / nullif0(bought + sold), "taker_buy_ratio": bought / nullif0(bought + sold), "avg_trade_size": (bought + sold) / F.col("trade_count"), "large_trade_net_flow": F.col("large_buy_vol") - F.col("large_sell_vol"), "sell_trade_count": F.col("trade_count") - F.col("buy_trade_count")})
    return flow.withColumn("trade_count_imbalance", (F.col("buy_trade_count") - F.col("sell_trade_count")) / F.col("trade_count")).withColumnRenamed("hour", "ts")


def hourly_interest(metrics: DataFrame, last: list[str], mean: list[str], ts: str = "create_time") -> DataFrame:
    """Five-minute metrics by hour: the last non-null of some, the mean of others."""
    return metrics.groupBy(floor_to(ts, "hour").alias("ts")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in last], *[F.avg(c).alias(c) for c in mean])


def joined(perp: DataFrame, spot: DataFrame | None, funding: DataFrame | None, interest: DataFrame | None, flow: DataFrame | None) -> DataFrame:
    """perp bars with spot close, basis, funding carried on, open interest and flow; inputs that are missing are skipped."""
    df = left_many(perp, [spot.select("symbol", "ts", F.col("close").alias("spot_close")) if spot is not None else None, interest, flow], ["symbol", "ts"])
    if spot is not None:
        df = df.withColumn("basis", F.col("close") / nullif0(F.col("spot_close")) - 1)
    if funding is not None:
        df = asof(df, funding, ["fundingRate"], right_ts="fundingTime")
    return df


def basis_zscore(df: DataFrame, w: int = 168) -> DataFrame:
    return in_blocks(df, w, lambda x, r: x.withColumn("basis_z", r.zscore(F.col("basis"), w)))
