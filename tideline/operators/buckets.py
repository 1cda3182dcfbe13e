"""Buckets of an ordering column: how a key of any size is dealt to many tasks.

A bucket is a stretch of time (or of another ordered number) of one key. What a
bucket needs of those before it is one row a bucket, carried along them; the
window over these summaries is the only one that takes a key as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of time, or units of a plain number, in a bucket.
WIDTH = 3_600


def ticks(df: DataFrame, column: str) -> Column:
    """An ordering column as a number in the unit of widths: seconds of timestamps and dates (no time zone moves them), else the number itself."""
    kind, c = df.schema[column].dataType, f"`{column}`"
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / 1_000_000
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1_000_000
    if isinstance(kind, T.DateType):
        return F.unix_date(c) * 86_400.0
    return F.col(c)


def bucket_of(df: DataFrame, column: str, width: float = WIDTH) -> Column:
    return F.floor(ticks(df, column) / width)


def numbered(df: DataFrame, key: str = "symbol", order: str = "ts", pos: str = "pos", width: float = WIDTH * 24 * 30, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place (from 0) in its key by (order, ties): places in a bucket after the rows of earlier buckets, so no task holds a key. Null orders come first, in a bucket of their own."""
    rows = df.withColumn("_bucket", bucket_of(df, order, width))
    sizes = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order, *ties)) - 1
    found = rows.withColumn("_within", within).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    return found.withColumn(pos, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_key", "_at", "_before")


def carried(left: DataFrame, right: DataFrame, value: Column, key: str, left_ts: str, right_ts: str, exact: bool = True, largest: bool = False, width: float = WIDTH) -> DataFrame:
    """left's rows as _l with _r: value of the last right row at or before (exact) each of them, or the largest value of all those.

    Rows of both sides are dealt by (key, bucket) and sorted once. A bucket's value
    is found first, one row a bucket; those that hold left rows get what the buckets
    before them came to as a row in front. Of right rows at one time the greatest
    value wins; right rows without a key or time are never met, left ones meet none.
    """
    kinds = (left.select(F.struct(*[f"`{c}`" for c in left.columns])).schema[0].dataType, right.select(value).schema[0].dataType)
    known = right.where(F.col(right_ts).isNotNull() & F.col(key).isNotNull())
    a = left.select(F.col(key).alias("_key"), bucket_of(left, left_ts, width).alias("_bucket"), ticks(left, left_ts).cast("double").alias("_ts"), F.lit(1).alias("_side"), F.struct(*[f"`{c}`" for c in left.columns]).alias("_l"), F.lit(None).cast(kinds[1]).alias("_r"))
    b = known.select(F.col(key).alias("_key"), bucket_of(right, right_ts, width).alias("_bucket"), ticks(right, right_ts).cast("double").alias("_ts"), F.lit(0 if exact else 2).alias("_side"), F.lit(None).cast(kinds[0]).alias("_l"), value.alias("_r"))
    took = F.max("_r") if largest else F.max(F.struct("_ts", "_r"))["_r"]
    ends = b.groupBy("_key", "_bucket").agg(took.alias("_r"), F.lit(False).alias("_asked"))
    asked = a.where("_key is not null and _bucket is not null").groupBy("_key", "_bucket").agg(F.lit(None).cast(kinds[1]).alias("_r"), F.lit(True).alias("_asked"))
    marks = ends.unionByName(asked).groupBy("_key", "_bucket").agg(F.max("_r").alias("_r"), F.bool_or("_asked").alias("_asked"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each bucket
    came = F.max("_r").over(earlier) if largest else F.last("_r", ignorenulls=True).over(earlier)
    front = marks.withColumn("_r", came).where("_asked and _r is not null").select("_key", "_bucket", F.lit(float("-inf")).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[0]).alias("_l"), "_r")
    over = Window.partitionBy("_key", "_bucket").orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    value_at = F.max("_r").over(over) if largest else F.last("_r", ignorenulls=True).over(over)
    rows = a.unionByName(b).unionByName(front).withColumn("_r", value_at).where("_side = 1")
    return rows.withColumn("_r", F.when(F.col("_ts").isNotNull() & F.col("_key").isNotNull(), F.col("_r"))).select("_l", "_r")
