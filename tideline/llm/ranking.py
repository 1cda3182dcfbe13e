"""Gapless ranks within keys of any size, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key's rows are ranked in parts of about this many.
PART_ROWS = 20_000


def ranked(df: DataFrame, key: str, order: list[str], rank: str, parts: int) -> DataFrame:
    """df with a rank from 0 in each key: by part (a hash of order), then by order.

    parts is the same for all keys; df is read twice, so it should be a stored
    table. Repeated rows get ranks of their own; null keys are a key.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(max(1, parts))).cast("int")
    split = df.withColumn("_part", part)
    sizes = split.groupBy(key, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    numbered = split.withColumn("_within", within)
    return numbered.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of"))).withColumn(rank, F.col("_before") + F.col("_within")).drop("_part", "_size", "_key", "_of", "_before", "_within")


def parts_for(rows: int) -> int:
    return max(8, -(-rows // PART_ROWS))
