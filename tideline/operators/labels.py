"""Labels: forward direction, triple barrier, label ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling
from tideline.operators.align import forward_path


def direction(bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)) -> DataFrame:
    """fwdret_n and label_dir_n (1 if above 0, ties 0); null in the last n bars."""
    r = Rolling()
    out = {}
    for n in horizons:
        after = r.lead(F.col("close"), n)
        move = F.when((after > 0) & (F.col("close") > 0), F.log(after / F.col("close")))
        out |= {f"fwdret_{n}": move, f"label_dir_{n}": F.when(after.isNotNull(), F.coalesce((move > 0).cast("double"), F.lit(0.0)))}
    return bars.withColumns(out)


def triple_barrier(events: DataFrame, bars: DataFrame, n: int = 10, factor: float = 2.0, least: float = 1.0, direction_col: str = "signal", id_cols: tuple[str, ...] = ("symbol", "pos")) -> DataFrame:
    """events (symbol, pos, entry_price, atr_pct, direction) with outcome, ret, label and bars_to_exit.

    The barriers are max(factor * ATR %, least) % away. If one bar touches both,
    the adverse one counts (lower_ambiguous). Without a touch the n-th bar's close
    decides; a bar missing before that gives no_data. direction_col must be the
    raw signal, not what was executed.
    """
    wide = events.withColumn("width", F.greatest(factor * F.col("atr_pct"), F.lit(least)) / 100).withColumn("_long", F.upper(F.trim(F.col(direction_col))).isin("BUY", "LONG"))
    path = forward_path(wide, bars, n)
    up, down = F.col("bar.high") >= F.col("entry_price") * (1 + F.col("width")), F.col("bar.low") <= F.col("entry_price") * (1 - F.col("width"))
    won, lost = F.when(F.col("_long"), up).otherwise(down), F.when(F.col("_long"), down).otherwise(up)
    path = path.withColumn("_hit", F.when(won & lost, "lower_ambiguous").when(lost, "lower").when(won, "upper"))
    gone = F.col("bar.close") / F.col("entry_price") - 1
    path = path.withColumn("_ret", F.when(F.col("_long"), gone).otherwise(-gone))
    got = path.groupBy(*id_cols).agg(
        F.min(F.when(F.col("_hit").isNotNull(), F.struct("bar_no", "_hit", "width"))).alias("hit"),
        F.max_by("_ret", F.when(F.col("bar_no") == n, F.col("bar_no"))).alias("last_ret"),
        F.max(F.when(F.col("bar_no") == n, 1)).alias("complete"),
        F.count("*").alias("seen"),
        F.min(F.struct("bar_no")).alias("_first"),
    )
    outcome = F.when(F.col("hit").isNotNull() & (F.col("hit.bar_no") <= F.col("seen")), F.col("hit._hit")).when(F.col("seen") == n, "time").otherwise("no_data")
    done = events.join(got, list(id_cols), "left").withColumn("outcome", F.coalesce(outcome, F.lit("no_data")))
    ret = F.when(F.col("outcome") == "upper", F.col("hit.width")).when(F.col("outcome").isin("lower", "lower_ambiguous"), -F.col("hit.width")).when(F.col("outcome") == "time", F.col("last_ret"))
    done = done.withColumn("ret", ret).withColumn("label", F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("int")))
    return done.withColumn("bars_to_exit", F.when(F.col("outcome") == "time", F.lit(n)).when(F.col("outcome") != "no_data", F.col("hit.bar_no"))).drop("hit", "last_ret", "complete", "seen", "_first")


def label_ends(bars: DataFrame, horizon: int) -> DataFrame:
    """t1: the time horizon bars on, the last time at the end."""
    whole = Window.partitionBy("symbol")
    return bars.withColumn("t1", F.coalesce(Rolling().lead(F.col("ts"), horizon), F.max("ts").over(whole)))
