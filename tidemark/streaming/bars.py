"""Ticks to bars as they arrive: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``symbol, start, open, high, low, close, volume`` of each closed window; works on streams and tables.

    First and last go by time, then by ``event_id``. On a stream a window is final, and emitted once, when the
    watermark passes its end; ticks later than ``delay`` are dropped, as any watermark does.
    """
    at = F.struct("timestamp", "event_id")
    grouped = ticks.filter("price IS NOT NULL").withWatermark("timestamp", delay).groupBy(F.window("timestamp", width), "symbol")
    out = grouped.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Start the query that appends closed bars to Parquet, exactly once; it ends when what is there has been read."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
