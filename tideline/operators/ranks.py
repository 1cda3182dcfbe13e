"""Ranks and exact quantiles of keys of any size.

A key's values are cut into slices at approximate quantiles (a sketch of bounded
size for each key). How many values lie in each slice is a partial aggregation;
places in a slice start behind those of the slices before. Equal values are one row
with a count before anything is sorted, so a tie of any size is in one slice and
costs nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.shared import stored

#: Slices of a key, and how finely their bounds are sketched.
SLICES, ACCURACY = 64, 1_000


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def _named(df: DataFrame, keys: list[str], prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *columns)


def joined(df: DataFrame, other: DataFrame, keys: list[str], *columns: str, how: str = "inner") -> DataFrame:
    """df with columns of other, which has a row for each key; null keys are keys. Without keys other is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(other.select(*columns)))
    return df.join(_named(other, keys, "_j_", *columns), _same(keys, "_j_"), how).drop(*[f"_j_{k}" for k in keys])


def sliced(df: DataFrame, value: str, keys: list[str], slices: int = SLICES) -> DataFrame:
    """df with _slice, which grows with value in each key; equal values share one."""
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, ACCURACY)).alias("_bounds"))
    return joined(df, bounds, keys, "_bounds").withColumn("_slice", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")


def offsets(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _slice, _before, _all) of rows with _n: how many there are in earlier slices of a key, and in all. A row a slice."""
    sizes = counted.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_size"))
    over = Window.partitionBy(*keys)
    return sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(over.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_size").over(over).alias("_all"))


def value_ranks(df: DataFrame, value: str, keys: list[str], more: dict[str, Column] | None = None, slices: int = SLICES) -> DataFrame:
    """(keys, value, _n, _first, more): each distinct value with its count, how many rows of the key are smaller, and aggregates of its rows. Null values must be filtered before."""
    counted = sliced(stored(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in (more or {}).items()])), value, keys, slices)
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = joined(counted.withColumn("_within", within), offsets(counted, keys), [*keys, "_slice"], "_before")
    return placed.withColumn("_first", F.col("_before") + F.col("_within")).drop("_slice", "_within", "_before")


def average_rank() -> Column:
    """Of value_ranks: from 1, ties sharing the mean of their places."""
    return F.col("_first") + (F.col("_n") + 1) / 2


def rank_in(df: DataFrame, value: str, out: str, keys: list[str], slices: int = SLICES) -> DataFrame:
    """df with average ranks of non-null values within keys; df is read twice."""
    found = value_ranks(df, value, keys, slices=slices).withColumn(out, average_rank())
    return joined(df, found, [*keys, value], out)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: list[str] | None = None, slices: int = 4 * SLICES) -> DataFrame:
    """(keys, a column for each share): exact quantiles, interpolated between neighbours; nulls and NaN don't count, and a key without values has no row.

    The values are written once. Rows are only counted by slice; those of the few slices that hold a wanted place
    are counted by value.
    """
    keys = keys or []
    rows = sliced(stored(df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")), "_v", keys, slices)
    starts = offsets(rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")), keys)
    ends = starts.withColumn("_next", F.lead("_before", 1).over(Window.partitionBy(*keys).orderBy("_slice"))).withColumn("_next", F.coalesce("_next", "_all"))
    # The two places between which each share lies.
    place = lambda s: F.lit(float(s)) * (F.col("_all") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), side(place(s)).cast("long").alias("at"), F.lit(i).alias("side"), (place(s) - F.floor(place(s))).alias("part")) for name, s in shares.items() for i, side in enumerate((F.floor, F.ceil))])
    asked = ends.withColumn("_w", F.explode(wanted)).where("_w.at >= _before and _w.at < _next").select(*keys, "_slice", "_before", "_w.*")
    by = [*keys, "_slice"]
    held = rows.join(_named(asked.select(*by).distinct(), by, "_j_"), _same(by, "_j_"), "left_semi").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    valued = held.withColumn("_to", upto)
    met = valued.join(_named(asked, by, "_j_", "_before", "name", "at", "side", "part"), _same(by, "_j_")).where("at - _before < _to and at - _before >= _to - _n")
    low, high = (F.max(F.when(F.col("side") == i, F.col("_v"))) for i in (0, 1))
    each = met.groupBy(*keys, "name").agg((low + (high - low) * F.max("part")).alias("q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares])
