"""Stored tables, Arrow batches and schemas of this subpackage's operators."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tideline.sources.shared import scratch, shared_folder, stored

__all__ = ["narrow_batches", "release", "scratch", "shared_folder", "stored", "with_fields"]


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished jobs go. They do when the driver has forgotten the job, which else waits for its heap to fill: a query of many jobs would keep them all on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of texts sent to a Python worker at once. Ten thousand, the default, are tens of megabytes on both sides of the hop.
BATCH_ROWS = 1_000


def narrow_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; texts are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with more fields; StructType.add would change the given one."""
    return T.StructType([*schema.fields, *T.DataType.fromDDL(ddl).fields])
