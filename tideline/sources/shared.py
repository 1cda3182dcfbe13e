"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this driver, newest last.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only on a local master, where driver and executors are one machine, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/tideline-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: later jobs neither compute it anew nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables by the file system of their path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Removes at its end the tables stored within, but those of the frames put into the yielded list.

    What is returned lazily from within must be written or kept first, as it reads them.
    """
    before, kept = len(_written), keep if keep is not None else []
    yield kept
    files = {f for df in kept for f in df.inputFiles()}
    gone = [p for p in _written[before:] if not any(p.rsplit("/", 1)[1] in f for f in files)]
    remove(spark, gone)
