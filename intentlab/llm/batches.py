"""Arrow batches bounded in rows and bytes, so that a task's memory does not follow text lengths."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 512
BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
