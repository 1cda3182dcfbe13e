"""Scans: files, zipped day files, paged services, and adapters of event tables."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideline.sources import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_bars_csv(spark: SparkSession, path: str, schema: str = schemas.BARS) -> DataFrame:
    """Bars in CSV files with a header; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def tape(events: DataFrame) -> DataFrame:
    """The event table as a tape of trades: one symbol for each type of event."""
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("trade_id"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        (F.lit(1.0) + F.get_json_object("props", "$.k").cast("double")).alias("quantity"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )


def order_tape(orders: DataFrame) -> DataFrame:
    """Orders as a tape: one symbol for each status."""
    return orders.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("quantity"))


def clean_klines(raw: DataFrame, now_ms: int | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """Typed, deduplicated bars of 12-field kline rows; with now_ms, only closed bars. Bad numbers become null. key: columns that name the series, if there are several."""
    rows = raw if now_ms is None else raw.where(F.col("close_time") <= now_ms)
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    return rows.select(*key, F.timestamp_millis("open_time").cast("timestamp_ntz").alias("ts"), *[number(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")], "trades").dropDuplicates([*key, "ts"])


def funding_rows(raw: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Funding prints: milliseconds to timestamps, errors in numbers to null, one row a time."""
    return raw.select(*key, F.timestamp_millis("fundingTime").cast("timestamp_ntz").alias("fundingTime"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("fundingRate", "markPrice")]).dropDuplicates([*key, "fundingTime"])


def without_repeated(df: DataFrame) -> DataFrame:
    """df without the columns that reading a joined file has doubled: a name of another column with .1, .2 behind it."""
    doubled = re.compile(r"(.+)\.\d+$")
    return df.select(*[f"`{c}`" for c in df.columns if not ((m := doubled.match(c)) and m[1] in df.columns)])


def days(spark: SparkSession, first: date | str, last: date | str) -> DataFrame:
    """Every day from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).alias("day"))


def unprocessed(all_days: DataFrame, done: DataFrame) -> DataFrame:
    return all_days.join(done.select("day").distinct(), "day", "left_anti")


def kept_or_fetched(spark: SparkSession, path: str, since: str, columns: list[str], fetch: Callable[[], DataFrame]) -> DataFrame:
    """Rows from since on of the table at path if there is one; else what fetch gives, after it has been kept there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        fetch().write.parquet(path)
    return spark.read.parquet(path).where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).select(*columns)


def read_zipped_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """The first member of each zip file under path, as rows of schema; files are read where they lie, in parallel."""
    return unzipped(spark.read.format("binaryFile").load(path), schema, header)


def unzipped(files: DataFrame, schema: str, header: bool = True) -> DataFrame:
    """The same of files that are there as content."""
    names = [f.split()[0] for f in schema.split(", ")]

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                    for part in pd.read_csv(member, header=0 if header else None, names=None if header else names, chunksize=50_000):
                        yield part[names]

    return files.select("content").mapInPandas(unzip, schema)


class Unavailable(Exception):
    """The service says that it has nothing for this day; unlike an error, that is final."""


def fetched(day_rows: DataFrame, fetch: Callable[[date], bytes], retries: int = 3) -> DataFrame:
    """(day, status, content) of each day: 'data', 'none' if the service says so, or 'failed' after all tries. Days are fetched in tasks; only the first two may be marked as done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for day in batch["day"]:
                status, content = "failed", None
                for _ in range(retries):
                    try:
                        status, content = "data", fetch(day)
                        break
                    except Unavailable:
                        status = "none"
                        break
                    except OSError:
                        continue
                yield pd.DataFrame({"day": [day], "status": [status], "content": [content]})

    return day_rows.select("day").distinct().mapInPandas(run, "day date, status string, content binary")


class PagedReader(DataSourceReader):
    """Reads a service page by page; each partition is a slice of time with a cursor of its own.

    Options: path of a folder of JSON-lines files of kline rows (a stand-in for the
    service, on any file system that Arrow opens), start and end (milliseconds),
    step (milliseconds of a bar), page_limit, slices, direction (forward or
    backward), retries and backoff (seconds, growing linearly) of a request, and
    failures, how often the stand-in fails before each answer.
    """

    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        start, end, n = int(self.o["start"]), int(self.o["end"]), int(self.o.get("slices", 1))
        width = max(1, -(-(end - start) // n))
        return [InputPartition((s, min(end, s + width))) for s in range(start, end, width)]

    def service(self) -> Callable[[int, int, int, bool], list[list]]:
        """What a request returns: at most limit rows with since <= open_time < until. Its files are read once a slice."""
        store, folder = fs.FileSystem.from_uri(self.o["path"]) if "://" in self.o["path"] or self.o["path"].startswith("file:") else (fs.LocalFileSystem(), self.o["path"])
        info = store.get_file_info(folder)
        files = [folder] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name[0] not in "._"]
        rows = sorted(json.loads(line) for f in files for line in store.open_input_stream(f).read().splitlines() if line)
        times, failures = [r[0] for r in rows], int(self.o.get("failures", 0))
        left = failures

        def page(since: int, until: int, limit: int, backward: bool) -> list[list]:
            nonlocal left
            if left:
                left -= 1
                raise OSError("the service is busy")
            left = failures
            found = rows[bisect_left(times, since) : bisect_left(times, until)]
            return found[-limit:] if backward else found[:limit]

        return page

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        since, until = partition.value
        limit, step, backward = int(self.o.get("page_limit", 1000)), int(self.o["step"]), self.o.get("direction", "forward") == "backward"
        page = self.service()
        while since < until:
            rows = retried(lambda a=since, b=until: page(a, b, limit, backward), int(self.o.get("retries", 5)), float(self.o.get("backoff", 1.0)))
            yield from map(tuple, rows)
            if len(rows) < limit:
                return
            if backward:
                until = rows[0][0]
            else:
                since = rows[-1][0] + step


def retried(request: Callable[[], list], retries: int, backoff: float) -> list:
    """A request made again after backoff, 2 * backoff, ... seconds; the last error is raised."""
    for attempt in range(1, retries + 1):
        try:
            return request()
        except OSError:
            if attempt == retries:
                raise
            time.sleep(backoff * attempt)
    raise ValueError("needs a retry at least")


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_klines").options(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_klines"

    def schema(self) -> str:
        return schemas.KLINES_RAW

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def milliseconds(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
