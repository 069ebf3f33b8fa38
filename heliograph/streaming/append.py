"""Appending a stream of operations to the audit log exactly once, whatever is sent or run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_once(operations: DataFrame, path: str, checkpoint: str, *, key: str = "id", at: str = "performed_at", late: str = "1 hour") -> StreamingQuery:
    """Start a query that adds each operation of a stream to the log below ``path`` once.

    A key that comes again within the watermark is dropped by the stream's state.  A batch
    that is run again after a stop has the same number and the same rows and replaces its
    own folder, so the log holds each batch once.  Read the log with ``batch=*`` below.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    once = operations.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
