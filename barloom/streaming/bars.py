"""Bars over an event stream, and signals whenever bars are complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of ``ticks(ticker, ts, event_id, price, value)`` over tumbling windows.

    State is one row per instrument and open window; ticks later than ``late`` are dropped.
    """
    order = F.struct("ts", "event_id")
    windowed = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", every).alias("w"))
    bars = windowed.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("value").alias("volume"))
    return bars.select("ticker", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def run_available(bars: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands closed bars to ``on_batch`` until the source has no more, then stops."""
    return bars.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
