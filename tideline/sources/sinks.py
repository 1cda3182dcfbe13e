"""Sinks: tables, append with days done, alerts, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def overwrite(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def append_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Idempotent append: the days in df replace those in path, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a CSV log; every file has the header, which readers skip. Also as a foreachBatch sink."""
    df.write.mode("append").option("header", True).csv(path)


def mark_done(day_rows: DataFrame, path: str) -> None:
    day_rows.select("day").distinct().write.mode("append").parquet(path)


def stream_days(days: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A resumable ETL of days from a stream of files, for what is there now: make(rows of a batch) gives rows with a day.

    A batch's rows and the days it has done are one write, to a folder named by its
    number, which a repeated batch overwrites: there is no moment at which a day is
    marked and not there, or there twice. Days without data are what make gives for
    them. streamed_days reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return days.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_days(spark: SparkSession, path: str, day: str = "day") -> DataFrame:
    """Rows of each day's latest batch: a day that comes again replaces what was there."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy(day).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [day, "batch"], "left_semi").drop("batch")


def alerts(scored: DataFrame, horizon: int = 1) -> DataFrame:
    """JSON alerts of scored bars whose action isn't SKIP, keyed by symbol and bar for an idempotent sink."""
    body = F.struct("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "action", F.round("probability", 4).alias("probability"), F.col("close").alias("close_price"), F.lit(horizon).alias("horizon_bars"))
    return scored.where("action <> 'SKIP'").select("symbol", "ts", F.to_json(body).alias("body"))


def post_each(send: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends each alert once; a failed send fails the batch, which is then tried again."""

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("symbol", "ts").toLocalIterator():
            send(row["body"])

    return run


def save_config(path: str, **values: object) -> None:
    with open(path, "w") as f:
        json.dump(values, f, indent=1, sort_keys=True, default=str)


def load_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def report(df: DataFrame, title: str, rows: int = 100) -> str:
    """A small frame as text."""
    small = df.limit(rows).toPandas()
    return f"{title}\n{small.to_string(index=False)}\n"
