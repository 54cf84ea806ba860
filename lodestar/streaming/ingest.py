"""Streaming ingest and running metrics with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.sources import store


def stream_ingest(rows: DataFrame, path: str, checkpoint: str, dim: int, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch to the store, as an epoch named after the checkpoint and the batch. A batch that runs again
    overwrites its own files, so rows come once.

    after: called with each batch's rows, as for refreshing an index.
    """

    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def each(batch: DataFrame, epoch: int) -> None:
        store.ingest_epoch(batch, path, dim, f"{name}-{epoch}")
        if after is not None:
            after(batch, epoch)

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def running_counter(events: DataFrame, *labels: str, at: str | None = None, lateness: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Counts by label as events come; with at and window, by window too, and state goes with the watermark."""
    if at is None or window is None:
        return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))
    return events.withWatermark(at, lateness).groupBy(F.window(at, window).alias("window"), *labels).agg(F.count(F.lit(1)).alias("value"))
