"""Statistics: series, ranks, tests, and multiple-testing corrections."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import Rolling, correlation
from tideline.operators.ranks import average_rank, joined, quantiles, value_ranks
from tideline.sources.shared import stored

_N = NormalDist()
EULER = 0.5772156649015329


def describe(bars: DataFrame) -> DataFrame:
    """Per symbol: moments of log returns, median, coefficient of variation of volume, trend of volume per day."""
    r = Rolling()
    df = bars.withColumn("r", r.log_return(F.col("close"), 1))
    first = F.min("ts").over(Window.partitionBy("symbol"))
    df = df.withColumn("day", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))) / 86400.0)
    n = F.count("r").cast("double")
    middle = quantiles(df, "r", {"median": 0.5}, ["symbol"])
    columns = ("symbol", "n", "mean", "std", "skew", "kurt", "least", "most", "median", "volume_cv", "volume_slope", "first_ts", "last_ts")
    moments = df.groupBy("symbol").agg(
        n.cast("long").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), (F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r") + 6)).alias("kurt"),
        F.min("r").alias("least"), F.max("r").alias("most"), (F.stddev_samp("volume") / F.avg("volume")).alias("volume_cv"), F.regr_slope("volume", "day").alias("volume_slope"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return joined(moments, middle, ["symbol"], "median", how="left").select(*columns)


def yearly(daily: DataFrame, least: int = 30) -> DataFrame:
    """Returns by year, each year's first day without one; years with fewer rows are left out."""
    over = Window.partitionBy("symbol", F.year("ts")).orderBy("ts")
    df = daily.withColumn("year", F.year("ts")).withColumn("r", F.log(F.col("close") / F.lag("close").over(over)))
    return df.groupBy("symbol", "year").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.sum("r").alias("total")).where(F.col("n") >= least)


def autocorrelations(series: DataFrame, value: str, lags: int = 10, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Per key: acf_1 .. of x, |x| and x squared and the Ljung-Box statistic of x; all pairs in one pass."""
    over = Window.partitionBy(key).orderBy(order)
    x = F.col(value)
    kinds = {"r": x, "abs": F.abs(x), "sq": x * x}
    rows = series.where(x.isNotNull())
    rows = rows.withColumns({f"_{k}0": e for k, e in kinds.items()})
    rows = rows.withColumns({f"_{k}{i}": F.lag(f"_{k}0", i).over(over) for k in kinds for i in range(1, lags + 1)})
    got = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.corr(f"_{k}0", f"_{k}{i}").alias(f"acf_{k}_{i}") for k in kinds for i in range(1, lags + 1)])
    lb = sum((F.col(f"acf_r_{i}") ** 2 / (F.col("n") - i) for i in range(1, lags + 1)), F.lit(0.0))
    return got.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * lb)


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, n, ic, p_value) over pairs without nulls; fewer than least pairs give no row, a constant side no correlation."""
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")))
    ranked = pairs
    for v in ("_x", "_y"):
        ranked = joined(ranked, value_ranks(pairs, v, keys).withColumn(f"_r{v}", average_rank()), [*keys, v], f"_r{v}")
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col("_r_x"), F.col("_r_y")).alias("ic")).where(F.col("n") >= least)
    t = F.abs("ic") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("ic") ** 2, F.lit(1e-300)))
    return got.withColumn("p_value", 2 * (1 - normal_cdf(t)))


def normal_cdf(x: F.Column) -> F.Column:
    """Normal distribution by a polynomial (Abramowitz and Stegun 26.2.17, fixed values), error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def auc(df: DataFrame, score: str, label: str, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n, auc) exactly, with ties, from average ranks; one class only or fewer than least rows give no row. Rows are counted by score first: ranks are of distinct scores."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ranked = value_ranks(rows, score, keys, {"_pos": F.sum((F.col(label) > 0).cast("double"))})
    got = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("_p"), F.sum(F.col("_pos") * average_rank()).alias("_s")).where((F.col("_p") > 0) & (F.col("_p") < F.col("n")) & (F.col("n") >= least))
    return got.withColumn("auc", (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * (F.col("n") - F.col("_p")))).drop("_p", "_s")


def information_table(df: DataFrame, features: list[str], horizons: tuple[int, ...] = (1, 4, 24), least: int = 100) -> DataFrame:
    """Rank correlation of each feature with each forward return, per symbol."""
    r = Rolling()
    fwd = df.withColumns({f"_f{h}": F.log(r.lead(F.col("close"), h) / F.col("close")) for h in horizons})
    long = fwd.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(h).alias("horizon"), F.col(f).cast("double").alias("x"), F.col(f"_f{h}").alias("y")) for f in features for h in horizons])).alias("p")).select("symbol", "p.*")
    return spearman(long, "x", "y", ["symbol", "feature", "horizon"], least)


def binomial_tail(hits: int, n: int, p: float) -> float:
    """P(X >= hits), summed in logs."""
    if hits <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(hits, n + 1)]
    top = max(logs, default=-math.inf)
    return math.exp(top) * sum(math.exp(v - top) for v in logs) if logs else 0.0


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    """Of so many skill-less trials, by the extreme value of normals."""
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _N.inv_cdf(1 - 1 / trials) + EULER * _N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, kurt: float = 3.0, variance: float = 1.0) -> float:
    """Chance that the Sharpe ratio is above what the best of so many trials shows without skill; variance of the ratio across trials, on the same scale."""
    bar = expected_max_sharpe(trials, variance)
    spread = math.sqrt(max(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2))
    return _N.cdf((sharpe - bar) * math.sqrt(n - 1) / spread)


def distribution(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, least, most, mean, std) of predictions."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def agreement(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_long, win_rate, agreement) of signals (raw_long, made_long, won)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("raw_long").cast("long")).alias("n_long"), F.avg("won").alias("win_rate"), F.avg((F.col("raw_long") == F.col("made_long")).cast("double")).alias("agreement"))


def deflated_table(returns: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, sharpe, expected_max, deflated): each key is a trial of one search. Moments are distributed; a row a trial is left, of which the last steps are made."""
    x = F.col(value)
    each = returns.groupBy(*keys).agg(F.count(x).alias("n"), (F.avg(x) / F.stddev_samp(x)).alias("sharpe"), F.skewness(x).alias("_skew"), (F.kurtosis(x) + 3).alias("_kurt"))
    trials = each.agg(F.count("sharpe").alias("_trials"), F.var_samp("sharpe").alias("_var"))
    schema = ", ".join([*[f"`{k}` {each.schema[k].dataType.simpleString()}" for k in keys], "n long, sharpe double, expected_max double, deflated double"])

    def run(batches):
        for b in batches:
            bar = [expected_max_sharpe(int(t), v) for t, v in zip(b["_trials"], b["_var"], strict=True)]
            last = [deflated_sharpe(s, int(t), int(n), g, k, v) for s, t, n, g, k, v in zip(b["sharpe"], b["_trials"], b["n"], b["_skew"], b["_kurt"], b["_var"], strict=True)]
            yield b[[*keys, "n", "sharpe"]].assign(expected_max=bar, deflated=last)

    return each.where("sharpe is not null").crossJoin(F.broadcast(trials)).mapInPandas(run, schema)


def overfitting(returns: DataFrame, chunks: int = 12) -> DataFrame:
    """One row (pbo, n_splits, mean_logit) of (strategy_id, obs_no, ret): combinatorially symmetric cross-validation.

    Each strategy keeps n, sum and sum of squares per chunk; every half of the
    chunks is a split, whose Sharpe ratios come from those moments alone.
    """
    spark = returns.sparkSession
    n = returns.agg(F.max("obs_no").alias("n")).first()["n"] + 1
    size, longer = divmod(n, chunks)
    edge = longer * (size + 1)  # the first chunks are one longer
    chunk = F.when(F.col("obs_no") < edge, F.floor(F.col("obs_no") / (size + 1))).otherwise(longer + F.floor((F.col("obs_no") - edge) / max(size, 1))).cast("int")
    part = returns.groupBy("strategy_id", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    halves = list(combinations(range(chunks), chunks // 2))
    member = spark.createDataFrame([(i, c, c in h) for i, h in enumerate(halves) for c in range(chunks)], "split int, chunk int, inside boolean")
    sums = part.join(F.broadcast(member), "chunk").groupBy("split", "strategy_id", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    sharpe = sums.withColumn("v", F.when(spread > 1e-15, mean / spread))
    wide = sharpe.groupBy("split", "strategy_id").agg(F.max(F.when(F.col("inside"), F.col("v"))).alias("is_v"), F.max(F.when(~F.col("inside"), F.col("v"))).alias("oos_v"))
    known = wide.where("is_v is not null and oos_v is not null")
    ranked = known.withColumns({"rk": F.rank().over(Window.partitionBy("split").orderBy("oos_v")), "total": F.count("*").over(Window.partitionBy("split"))})
    best = ranked.groupBy("split").agg(F.min_by(F.struct("rk", "total"), F.struct(-F.col("is_v"), F.col("strategy_id"))).alias("b"))
    w = F.col("b.rk") / (F.col("b.total") + 1)
    return best.withColumn("logit", F.log(w / (1 - w))).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"), F.avg("logit").alias("mean_logit"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, cramers_v) of two categorical columns."""
    n = df.groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    n = n.withColumns({"ra": F.sum("o").over(Window.partitionBy(a)), "rb": F.sum("o").over(Window.partitionBy(b))})
    total = df.agg(F.count("*").cast("double").alias("t"), F.least(F.count_distinct(a), F.count_distinct(b)).alias("k"))
    cells = n.crossJoin(F.broadcast(total))
    expected = F.col("ra") * F.col("rb") / F.col("t")
    return cells.agg((F.sum(F.col("o") ** 2 / expected) - F.max("t")).alias("chi2"), F.max("t").alias("t"), F.max("k").alias("k")).select("chi2", F.sqrt(F.col("chi2") / (F.col("t") * (F.col("k") - 1))).alias("cramers_v"))
