"""Studies composed of other operators: paths by confidence, input search, leakage comparison, ablation, guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import conviction
from tideline.operators import models, splits, stats
from tideline.operators.align import forward_path
from tideline.operators.ranks import quantiles
from tideline.operators.sim import decay, summary


def paths_by_confidence(events: DataFrame, bars: DataFrame, n: int = 20, score: str = "score") -> DataFrame:
    """Mean return at each bar after an event for the top and bottom quarter by score and the middle. events: symbol, pos, entry_price, score."""
    edges = quantiles(events, score, {"_lo": 0.25, "_hi": 0.75})
    named = events.crossJoin(F.broadcast(edges)).withColumn("bucket", F.when(F.col(score) >= F.col("_hi"), "top").when(F.col(score) <= F.col("_lo"), "bottom").otherwise("middle")).drop("_lo", "_hi")
    path = forward_path(named, bars, n)
    return path.groupBy("bucket", "bar_no").agg(F.avg(F.col("bar.close") / F.col("entry_price") - 1).alias("mean_return"), F.count("*").alias("n"))


#: P(X <= 0), P(X <= 1), ... of a Poisson variable of mean 1: fixed values.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def uniform(rows: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row key and draw, the same wherever the row is."""
    x = rows[:, None].astype(np.uint64) + np.arange(1, draws + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def bootstrap_gap(values: DataFrame, value: str, group: str, a: str, b: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Mean difference of two groups with a 95 % interval: each row counts a Poisson(1) number of times in each draw, which is a distributed bootstrap.

    Rows that are equal in all columns are drawn apart. A batch of rows adds a
    number of values and a sum for each draw and group; no row is copied.
    """
    copies = Window.partitionBy(*values.columns).orderBy(F.lit(0))
    rows = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).withColumn("_copy", F.row_number().over(copies))
    rows = rows.select(F.xxhash64(*values.columns, "_copy").alias("row"), (F.col(group) == a).alias("first"), F.col(value).cast("double").alias("v"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            times = np.searchsorted(np.array(POISSON), uniform(batch["row"].to_numpy().view(np.uint64), draws, seed), side="right")
            for first in (True, False):
                at = (batch["first"] == first).to_numpy()
                yield pd.DataFrame({"draw": range(draws), "first": first, "n": times[at].sum(axis=0), "s": batch["v"].to_numpy()[at] @ times[at]})

    sums = rows.mapInPandas(part, "draw int, first boolean, n long, s double").groupBy("draw", "first").agg((F.sum("s") / F.sum("n")).alias("m"))
    gaps = sums.groupBy("draw").agg((F.max(F.when(F.col("first"), F.col("m"))) - F.max(F.when(~F.col("first"), F.col("m")))).alias("gap"))
    return gaps.agg(F.avg("gap").alias("gap"), F.percentile("gap", F.lit(0.025)).alias("low"), F.percentile("gap", F.lit(0.975)).alias("high"))


def input_search(fired: DataFrame, predictions: DataFrame, least: int = 30, per_day: tuple[float, float] | None = (1.5, 2.5)) -> DataFrame:
    """Configurations by mean conviction, agreement and AUC of a model's predictions where their signals fire, of those that fire so often a day (None: of all). fired: symbol, config_id, pos, dir, n_days; predictions: symbol, pos, pred, actual."""
    both = fired.join(predictions, ["symbol", "pos"])
    agree = ((F.col("pred") >= 0.5) == (F.col("dir") > 0)).cast("double")
    base = both.groupBy("config_id").agg(F.count("*").alias("n"), F.avg(conviction(F.col("pred"))).alias("mean_conviction"), F.avg(agree).alias("agreement"), F.max("n_days").alias("_days"))
    often = F.lit(True) if per_day is None else (F.col("n") / F.col("_days")).between(*per_day)
    scored = stats.auc(both, "pred", "actual", ["config_id"], least).select("config_id", "auc")
    return base.where((F.col("n") >= least) & often).drop("_days").join(scored, "config_id", "left")


def generalization(search: DataFrame, check: DataFrame, by: str = "win_rate") -> DataFrame:
    """Decay of the best, with a one-sided binomial test of profitable ones against the share among all."""
    top = decay(search, check, by)
    base = search.join(check.select("symbol", "config_id", F.col("total_pnl").alias("later")), ["symbol", "config_id"]).agg(F.avg(((F.col("total_pnl") > 0) & (F.col("later") > 0)).cast("double")).alias("p")).first()["p"] or 0.0
    rows = [(r["top"], r["found"], r["held"], r["both_profitable"], base, stats.binomial_tail(round(r["both_profitable"] * r["top"]), r["top"], min(max(base, 1e-9), 1 - 1e-9))) for r in top.collect()]  # a row for each size of top
    return search.sparkSession.createDataFrame(rows, "top int, found double, held double, both_profitable double, by_chance double, p_value double")


def exit_study(search: DataFrame, check: DataFrame, least: int = 100, least_later: int = 20, keys: tuple[str, ...] = ("symbol", "config_id")) -> DataFrame:
    """Configurations with enough trades in both periods: trades, win rates and profit factors of each, and whether both made a profit."""
    later = check.where(F.col("n_trades") >= least_later).select(*keys, F.col("n_trades").alias("later_trades"), F.col("win_rate").alias("later_win_rate"), F.col("profit_factor").alias("later_profit_factor"))
    both = search.where(F.col("n_trades") >= least).join(later, list(keys))
    return both.select(*keys, "n_trades", "later_trades", "win_rate", "profit_factor", "later_win_rate", "later_profit_factor", ((F.col("profit_factor") > 1) & (F.col("later_profit_factor") > 1)).alias("both_profitable"))


def search_correlation(search: DataFrame, check: DataFrame, measures: tuple[str, ...] = ("win_rate", "n_trades"), least: int = 10) -> DataFrame:
    """(symbol, measure, n, ic, p_value): how far the order of configurations in a search is their order in the check period."""
    keys = ["symbol", "config_id"]
    both = search.select(*keys, F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures]).alias("a"))
    later = check.select(*keys, F.array(*[F.col(m).cast("double") for m in measures]).alias("b"))
    rows = both.join(later, keys).select("symbol", F.explode(F.arrays_zip("a", "b")).alias("v")).select("symbol", "v.a.measure", "v.a.x", F.col("v.b").alias("y"))
    return stats.spearman(rows, "x", "y", ["symbol", "measure"], least)


def effective_size(spans: DataFrame, bars: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, n, effective_n, mean_concurrency) of each series: labels, the sum of their uniqueness, and how many cover a bar that any covers."""
    profile = splits.bar_profile(spans, bars, key=key)
    u = splits.uniqueness_of(spans, profile, key).groupBy(key).agg(F.count("*").alias("n"), F.sum("uniqueness").alias("effective_n"))
    return u.join(profile.where("n_concurrent > 0").groupBy(key).agg(F.avg("n_concurrent").alias("mean_concurrency")), key)


def purge_by_exit(train: DataFrame, first_test_pos: int) -> DataFrame:
    """Signals whose trades end before a test begins."""
    return train.where(F.col("pos") + F.col("bars_to_exit") < first_test_pos)


def inner_split(rows: DataFrame, share: float = 0.85, key: str = "symbol") -> DataFrame:
    """inner: the first share of each series' positions trains, the rest stops early."""
    over = Window.partitionBy(key)
    first, last = F.min("pos").over(over), F.max("pos").over(over)
    return rows.withColumn("inner", F.when(F.col("pos") < first + (last - first) * share, "fit").otherwise("stop"))


def weight_schemes(spans: DataFrame, bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Weights A to E of spans: none, uniqueness, returns, uniqueness with decay, uniqueness with recency; all from one profile of the bars."""
    profile = splits.bar_profile(spans, bars, "logret", key)
    both = splits.span_sums(spans, profile, {"_u": "unique_to", "_r": "return_to"}, key).withColumn("uniqueness", F.col("_u") / (F.col("end") - F.col("start") + 1))
    weighed = splits.time_decay(splits.of_mean_one(both, F.abs("_r"), "C", key, F.lit(1.0)), 0.5, key=key)
    aged = splits.recency_by_bars(weighed, pos="start", key=key)
    return aged.select(key, "start", "end", F.lit(1.0).alias("A"), F.col("uniqueness").alias("B"), "C", (F.col("uniqueness") * F.col("decay")).alias("D"), (F.col("uniqueness") * F.col("weight")).alias("E"))


def schemes_of_folds(df: DataFrame, label: str, horizon: int, k: int, key: str = "symbol") -> dict[str, DataFrame]:
    """Four ways to part the rows of each series (key, pos): shuffled, in blocks, purged, and purged with an embargo; each (key, pos, fold, role)."""
    last = F.max("pos").over(Window.partitionBy(key))
    spans = df.select(key, "pos", F.least(F.col("pos") + horizon, last).alias("end"))
    fold = df.sparkSession.range(k).select(F.col("id").cast("int").alias("_f"))  # k rows
    every = lambda folds: folds.crossJoin(F.broadcast(fold)).select(key, "pos", F.col("_f").alias("fold"), F.when(F.col("fold") == F.col("_f"), "test").otherwise("train").alias("role"))
    blocks = splits.purged_kfold(spans.withColumn("end", F.col("pos")), None, k, 0.0, key)
    named = lambda folds: folds.withColumnRenamed("split_id", "fold")
    return {
        "shuffled": every(splits.shuffled_kfold(df.select(key, "pos", label), k, 0, label, key).select(key, "pos", "fold")),
        "blocks": named(blocks),
        "purged": named(splits.purged_kfold(spans, None, k, 0.0, key)),
        "purged_embargo": named(splits.purged_kfold(spans, None, k, 0.01, key)),
    }


def leakage_comparison(df: DataFrame, features: list[str], label: str, horizon: int, k: int = 3, key: str = "symbol", **settings) -> DataFrame:
    """Mean and spread of fold AUCs under four schemes: what shuffled folds show above purged ones is leakage. df: key, pos, features, label."""
    out = None
    for name, folds in schemes_of_folds(df, label, horizon, k, key).items():
        got = models.fold_aucs(models.out_of_fold(df, folds, features, label, [0], on=(key, "pos"), **settings), label).withColumn("scheme", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("scheme").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd"), F.count("*").alias("folds"))


def ablation(df: DataFrame, folds: DataFrame, sets: dict[str, list[str]], label: str, **settings) -> DataFrame:
    """Mean fold AUC of each set of features."""
    out = None
    for name, features in sets.items():
        got = models.fold_aucs(models.out_of_fold(df, folds, features, label, [0], **settings), label).agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd")).withColumn("features", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by hash: the same on every run, whatever the partitioning. The limit is the feature."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def assert_aligned(a: DataFrame, b: DataFrame, on: list[str]) -> None:
    """Raises unless both frames have the same keys, as often."""
    x, y = a.select(*on), b.select(*on)
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise ValueError("rows are not aligned")


def latest_complete(features: DataFrame, columns: list[str]) -> DataFrame:
    """The last row of each symbol; raises if any of its columns is null."""
    last = features.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("_n = 1").drop("_n")
    holes = last.where(" or ".join(f"`{c}` is null" for c in columns))
    if not holes.isEmpty():
        raise ValueError("the latest row has missing features")
    return last


def evaluate_all(trades: DataFrame) -> DataFrame:
    return summary(trades, ["symbol", "config_id"])
