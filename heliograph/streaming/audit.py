"""The audit log as a stream: tallies of operations by time window, late rows allowed for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.schemas import FILE_OPERATIONS


def operations_stream(spark: SparkSession, path: str, schema: str = FILE_OPERATIONS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tallies(operations: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, op, n, bytes) by window; also works on a batch."""
    timed = operations.withWatermark("performed_at", late) if operations.isStreaming else operations
    per = timed.groupBy(F.window("performed_at", every), "op").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return per.select(F.col("window.start").alias("start"), "op", "n", "bytes")
