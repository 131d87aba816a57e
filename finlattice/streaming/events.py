"""Windowed counters over the event log, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, ts: str, kind: str, ms: str, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """window_start, kind, events, total_ms per tumbling window; `late` sets the watermark of a stream.

    State is one row per open window and kind. Rows without a time count nowhere.
    """
    if late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, size).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("events"), F.sum(ms).alias("total_ms"))
    return g.select(F.col("w.start").alias("window_start"), "kind", "events", "total_ms")


def append_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows as Parquet; takes what is there, then stops. Restarts resume at the checkpoint."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
