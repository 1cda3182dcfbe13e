"""Splits without leakage, and sample weights. Spans are positions (start, end), both included.

Everything works on one series or, with key, on every series of a table apart.
Running sums are made in blocks of positions, from a table written once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.buckets import WIDTH, carried
from tideline.sources.shared import stored

#: Rows of one series that a task sums along; longer series run in blocks.
BLOCK = 100_000


def keys_of(key: str | None) -> list[str]:
    return [key] if key else []


def running_sums(df: DataFrame, sums: dict[str, str], order: list[str], block: int = BLOCK, key: str | None = None) -> DataFrame:
    """df with each out summed along order (sums: out -> value), whose first column is a position from 0. Blocks of positions are summed apart and start from the sums of those before, so no task holds a series."""
    by = [*keys_of(key), "_b"]
    rows = stored(df).withColumn("_b", F.floor(F.col(order[0]) / block))
    before = Window.partitionBy(*keys_of(key)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each block
    totals = rows.groupBy(*by).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(sums.values())])
    starts = totals.select(*by, *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({out: F.sum(v).over(within) for out, v in sums.items()}).join(starts, by)
    return summed.withColumns({out: F.col(out) + F.col(f"_s{i}") for i, out in enumerate(sums)}).drop("_b", *[f"_s{i}" for i in range(len(sums))])


def running_sum(df: DataFrame, value: str, out: str, order: list[str], block: int = BLOCK, key: str | None = None) -> DataFrame:
    return running_sums(df, {out: value}, order, block, key)


def purge(train: DataFrame, tests: DataFrame, t0: str = "t0", t1: str = "t1", key: str | None = None, width: float = WIDTH) -> DataFrame:
    """train without rows whose span meets a test span (of the same series, with key); both ends belong to a span.

    A span [a, b] meets a test span if and only if, of the test spans that begin at
    or before b, the furthest end is at or after a. So each row looks up one running
    maximum, as an as-of join by buckets of width: no pairs of spans, whatever their
    length and number. Spans with a null end meet none.
    """
    by = key or "_one"
    a, b = (df if key else df.withColumn(by, F.lit(0)) for df in (train, tests.where(F.col(t1).isNotNull())))
    found = carried(a, b, F.struct(F.col(t1).alias("end")), by, t1, t0, largest=True, width=width)
    kept = found.where(F.coalesce(F.col("_r.end") < F.col(f"_l.{t0}"), F.lit(True)))
    return kept.select(*[F.col(f"_l.`{c}`").alias(c) for c in train.columns])


def embargo_times(bars: DataFrame, share: float, key: str | None = None) -> DataFrame:
    """until: the time int(n * share) bars on, the last at the end. bars: pos, ts; a lookup by position, not a sort of all bars."""
    by = keys_of(key)
    last = bars.groupBy(*by).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    moved = per_series(bars, last, key).withColumn("_to", F.col("pos") + F.floor(F.col("n") * share))
    return moved.join(bars.select(*by, F.col("pos").alias("_to"), F.col("ts").alias("_at")), [*by, "_to"], "left").withColumn("until", F.coalesce("_at", "last")).drop("_to", "_at", "last", "n")


def per_series(df: DataFrame, one: DataFrame, key: str | None) -> DataFrame:
    """df with the columns of one, a row for each series."""
    return df.join(one, key) if key else df.crossJoin(F.broadcast(one))


def block_bounds(n: int, k: int) -> list[tuple[int, int]]:
    """k runs of positions, the first n % k one longer."""
    sizes = [n // k + (i < n % k) for i in range(k)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def blocks_of(spans: DataFrame, n: int | None, k: int, name: str, key: str | None) -> DataFrame:
    """(key, name, a, b, n): the bounds of block_bounds for each series; k rows a series. n: rows of the one series, if known."""
    if k < 2 or n is not None and n < k:
        raise ValueError("needs 2 <= splits <= rows")
    spark = spans.sparkSession
    sizes = spans.groupBy(*keys_of(key)).agg(F.count("*").alias("n")) if n is None else spark.createDataFrame([(n,)], "n long")
    each = sizes.where(F.col("n") >= k).withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size, longer, i = F.floor(F.col("n") / k), F.col("n") % k, F.col(name)
    return each.select(*keys_of(key), name, (i * size + F.least(i, longer)).alias("a"), ((i + 1) * size + F.least(i + 1, longer)).alias("b"), "n")


def label_reach(spans: DataFrame, folds: DataFrame, name: str, key: str | None) -> DataFrame:
    """folds with test_end, the last position that a label of theirs looks at."""
    inside = per_series(spans, folds, key).where("pos >= a and pos < b")
    return inside.groupBy(*keys_of(key), name, "a", "b", "n").agg(F.max("end").alias("test_end"))


def purged_kfold(spans: DataFrame, n: int | None, k: int, embargo: float = 0.0, key: str | None = None) -> DataFrame:
    """(key, split_id, pos, role) of rows (pos, end), end the last position a label looks at. A series has k bounds, so its rows meet a table of k rows."""
    last = label_reach(spans, blocks_of(spans, n, k, "split_id", key), "split_id", key)
    step = F.floor(F.col("n") * embargo)
    role = F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "test").when((F.col("pos") < F.col("a")) & (F.col("end") < F.col("a")), "train").when((F.col("pos") >= F.col("b")) & (F.col("pos") >= F.col("test_end") + 1 + step), "train")
    return per_series(spans, last, key).withColumn("role", role).where("role is not null").select(*keys_of(key), "split_id", "pos", "role")


def cpcv(spans: DataFrame, n: int | None, groups: int, tests: int, embargo: float = 0.0, key: str | None = None) -> DataFrame:
    """Combinatorial purged splits: every choice of test groups; (key, split_id, pos, role)."""
    spark, by = spans.sparkSession, keys_of(key)
    ends = label_reach(spans, blocks_of(spans, n, groups, "g", key), "g", key)
    choices = [(s, g) for s, c in enumerate(combinations(range(groups), tests)) for g in c]
    chosen = ends.join(F.broadcast(spark.createDataFrame(choices, "split_id int, g int")), "g")  # as many rows as there are choices
    inside = (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))
    meets = (F.col("pos") <= F.col("test_end")) & (F.col("end") >= F.col("a")) | (F.col("pos") > F.col("test_end")) & (F.col("pos") <= F.col("test_end") + F.floor(F.col("n") * embargo))
    marked = per_series(spans, chosen, key).groupBy(*by, "split_id", "pos").agg(F.bool_or(inside).alias("test"), F.bool_or(meets).alias("near"))
    return marked.withColumn("role", F.when(F.col("test"), "test").when(~F.col("near"), "train")).where("role is not null").select(*by, "split_id", "pos", "role")


def expanding_folds(n: int, first: float = 0.5, last: float = 0.9, k: int = 5, least_train: int = 500, least_test: int = 50) -> list[tuple[int, int, int]]:
    """(fold, train end, test end) with edges evenly from first * n to last * n, each fold's test up to the next edge."""
    edges = [int(x) for x in np.linspace(first * n, last * n, k + 1)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a >= least_train and b - a >= least_test]


def growing_folds(n: int, k: int = 5, start: float = 0.4) -> list[tuple[int, int, int]]:
    """(fold, train end, test end): equal tests after the first start * n, the last takes the rest."""
    a = int(n * start)
    size = (n - a) // k
    return [(i, a + i * size, n if i == k - 1 else a + (i + 1) * size) for i in range(k)]


def growing_folds_of(rows: DataFrame, key: str, k: int = 5, start: float = 0.4) -> DataFrame:
    """(key, fold, a, b): growing_folds of each series."""
    first = F.floor(F.col("n") * start)
    size, i = F.floor((F.col("n") - first) / k), F.col("fold")
    each = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select(key, "fold", (first + i * size).alias("a"), F.when(i == k - 1, F.col("n")).otherwise(first + (i + 1) * size).alias("b"))


def expanding_folds_of(rows: DataFrame, key: str, first: float = 0.5, last: float = 0.9, k: int = 5, least_train: int = 500, least_test: int = 50) -> DataFrame:
    """(key, fold, a, b): expanding_folds of each series."""
    edge = lambda i: (F.col("n") * (first + i * ((last - first) / k))).cast("long")
    each = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select(key, "fold", edge(F.col("fold")).alias("a"), edge(F.col("fold") + 1).alias("b")).where((F.col("a") >= least_train) & (F.col("b") - F.col("a") >= least_test))


def walk_forward(rows: DataFrame, folds: list[tuple[int, int, int]] | DataFrame, horizon: int, key: str | None = None) -> DataFrame:
    """(fold, role) of rows by pos; the 2 * horizon bars before a test are left out."""
    table = folds if isinstance(folds, DataFrame) else rows.sparkSession.createDataFrame(folds, "fold int, a long, b long")
    role = F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "test").when(F.col("pos") < F.col("a") - 2 * horizon, "train")
    return per_series(rows, table, key).withColumn("role", role).where("role is not null").drop("a", "b")


def ranked_by_hash(df: DataFrame, by: list[str], hashed: list[str], seed: int, slices: int = 256) -> DataFrame:
    """df with _rank (from 0) and _n within by, in an order of hashes. Ranks are counted within slices of the hash's range, so one large group isn't one task."""
    h = F.xxhash64(*hashed, F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_slice", F.floor((F.shiftrightunsigned("_h", 1) / float(1 << 63)) * slices).cast("int"))
    sizes = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(over.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "_slice", before.alias("_before"), F.sum("_c").over(over).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", *hashed)) - 1
    found = rows.withColumn("_place", place).join(starts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_slice").alias("_s"), "_before", "_n"), [F.col("_slice") == F.col("_s"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]])
    return found.withColumn("_rank", F.col("_before") + F.col("_place")).drop("_h", "_slice", "_s", "_before", "_place", *[f"_k_{c}" for c in by])


def shuffled_kfold(rows: DataFrame, k: int, seed: int, label: str | None = None, key: str | None = None) -> DataFrame:
    """Control without purging: shuffled folds of equal size, stratified by label if given."""
    by = [*keys_of(key), *([label] if label else [])]
    ranked = ranked_by_hash(rows, by, ["pos"], seed)
    # The first n % k folds are one longer.
    size, longer, i = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_rank")
    fold = F.when(i < longer * (size + 1), F.floor(i / (size + 1))).otherwise(longer + F.floor((i - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def concurrency(spans: DataFrame, bars: DataFrame, key: str | None = None) -> DataFrame:
    """bars (pos) with how many spans (start, end) cover each: steps up and down, summed along."""
    by = [*keys_of(key), "pos"]
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("s")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("s"))))
    steps = spans.select(*keys_of(key), ends.alias("e")).select(*keys_of(key), "e.pos", "e.s").groupBy(*by).agg(F.sum("s").alias("s"))
    stepped = bars.join(steps, by, "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return running_sums(stepped, {"n_concurrent": "s"}, ["pos"], key=key).drop("s")


def bar_profile(spans: DataFrame, bars: DataFrame, ret: str | None = None, key: str | None = None) -> DataFrame:
    """(key, pos, n_concurrent, running sums of 1 / n_concurrent and of returns / n_concurrent), written once; what all weights of spans look up."""
    covered, n = F.col("n_concurrent") > 0, F.col("n_concurrent")
    value = F.coalesce(F.col(ret), F.lit(0.0)) if ret else F.lit(0.0)
    c = concurrency(spans, bars, key).withColumns({"_u": F.when(covered, 1.0 / n).otherwise(0.0), "_r": F.when(covered, value / n).otherwise(0.0)})
    return stored(running_sums(c, {"unique_to": "_u", "return_to": "_r"}, ["pos"], key=key).select(*keys_of(key), "pos", "n_concurrent", "unique_to", "return_to"))


def span_sums(spans: DataFrame, profile: DataFrame, sums: dict[str, str], key: str | None = None) -> DataFrame:
    """spans with the sum over start..end of what profile holds running sums of (out -> column): two lookups."""
    by = keys_of(key)
    upper = profile.select(*by, F.col("pos").alias("end"), *[F.col(c).alias(f"_e{i}") for i, c in enumerate(sums.values())])
    lower = profile.select(*by, (F.col("pos") + 1).alias("start"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    found = spans.join(upper, [*by, "end"]).join(lower, [*by, "start"], "left")
    return found.withColumns({out: F.col(f"_e{i}") - F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i, out in enumerate(sums)}).drop(*[f"_{x}{i}" for i in range(len(sums)) for x in "es"])


def uniqueness_of(spans: DataFrame, profile: DataFrame, key: str | None = None) -> DataFrame:
    return span_sums(spans, profile, {"_total": "unique_to"}, key).withColumn("uniqueness", F.col("_total") / (F.col("end") - F.col("start") + 1)).drop("_total")


def average_uniqueness(spans: DataFrame, bars: DataFrame, key: str | None = None) -> DataFrame:
    return uniqueness_of(spans, bar_profile(spans, bars, key=key), key)


def of_mean_one(df: DataFrame, value: Column, out: str, key: str | None, otherwise: Column | None = None) -> DataFrame:
    """value over its mean in each series; otherwise where that is 0."""
    whole = Window.partitionBy(*keys_of(key)) if key else None
    rows = df.withColumn("_w", value)
    rows = rows.withColumn("_m", F.avg("_w").over(whole)) if key else rows.crossJoin(F.broadcast(rows.agg(F.avg("_w").alias("_m"))))
    shared = F.col("_w") / F.col("_m")
    return rows.withColumn(out, shared if otherwise is None else F.when(F.col("_m") > 0, shared).otherwise(otherwise)).drop("_w", "_m")


def weights_by_return(spans: DataFrame, profile: DataFrame, key: str | None = None) -> DataFrame:
    return of_mean_one(span_sums(spans, profile, {"_total": "return_to"}, key), F.abs("_total"), "weight", key, F.lit(1.0)).drop("_total")


def return_weights(spans: DataFrame, bars: DataFrame, ret: str = "logret", key: str | None = None) -> DataFrame:
    """Absolute sum of returns shared among concurrent spans, of mean 1; all ones if there are none."""
    return weights_by_return(spans, bar_profile(spans, bars, ret, key), key)


def time_decay(unique: DataFrame, last: float, order: str = "start", key: str | None = None) -> DataFrame:
    """Weights linear in running uniqueness, 1 for the newest; last is that of the oldest, negative leaves the oldest part 0."""
    df = running_sums(unique, {"_x": "uniqueness"}, [order, "end"], key=key)
    df = df.withColumn("_t", F.max("_x").over(Window.partitionBy(key))) if key else df.crossJoin(F.broadcast(df.agg(F.max("_x").alias("_t"))))
    slope = (1 - last) / F.col("_t") if last >= 0 else 1 / ((last + 1) * F.col("_t"))
    return df.withColumn("decay", F.greatest(1 - slope * (F.col("_t") - F.col("_x")), F.lit(0.0))).drop("_x", "_t")


def recency_by_days(df: DataFrame, ts: str = "ts", half_life: float = 180.0, key: str | None = None) -> DataFrame:
    """Halves every half_life days (whole days of age), of mean 1."""
    dated = df.withColumn("_last", F.max(ts).over(Window.partitionBy(key))) if key else df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("_last"))))
    age = F.floor((F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000)
    return of_mean_one(dated, F.exp(-np.log(2) * age / half_life), "weight", key).drop("_last")


def recency_by_bars(df: DataFrame, half_life: float = 4320.0, pos: str = "pos", key: str | None = None) -> DataFrame:
    """Halves every half_life bars; not normalised."""
    dated = df.withColumn("_last", F.max(pos).over(Window.partitionBy(key))) if key else df.crossJoin(F.broadcast(df.agg(F.max(pos).alias("_last"))))
    return dated.withColumn("weight", F.pow(F.lit(0.5), (F.col("_last") - F.col(pos)) / half_life)).drop("_last")


def sequential_bootstrap(start: np.ndarray, end: np.ndarray, n_bars: int, size: int, seed: int) -> list[int]:
    """Draws of spans, each with a chance in proportion to its uniqueness given those drawn; replicates run in parallel by seed."""
    rng, drawn = np.random.default_rng(seed), np.zeros(n_bars)
    out: list[int] = []
    for _ in range(size):
        shared = np.concatenate([[0.0], np.cumsum(1.0 / (drawn + 1))])
        u = (shared[end + 1] - shared[start]) / (end - start + 1)
        pick = int(rng.choice(len(start), p=u / u.sum()))
        out.append(pick)
        drawn[start[pick] : end[pick] + 1] += 1
    return out


def bootstrap_replicates(spans: DataFrame, size: int, seeds: list[int], key: str = "symbol") -> DataFrame:
    """(key, seed, draw, index): draws of each series and seed, in a task of their own; index counts the series' spans by (start, end). A series' spans must fit a task, as every draw depends on all before."""
    spark = spans.sparkSession
    rows = spans.select(key, "start", "end").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in seeds], "seed long")))
    kind = spans.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable")
        start, end = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        got = sequential_bootstrap(start, end, int(end.max()) + 1, size, int(pdf["seed"].iloc[0]))
        return pd.DataFrame({key: pdf[key].iloc[0], "seed": pdf["seed"].iloc[0], "draw": range(size), "index": got})

    return rows.groupBy(key, "seed").applyInPandas(run, f"`{key}` {kind}, seed long, draw long, index long")
