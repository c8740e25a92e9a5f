"""Bars over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.sources.bars import bar_columns


def bars_stream(stream: DataFrame, delay: str = "1 hour", width: str = "1 hour", key: str = "key", ts: str = "ts", value: str = "value") -> DataFrame:
    """One bar per key and window, emitted once the watermark has passed it.

    State holds one partial bar per key and open window, not the ticks.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, width), key).agg(*bar_columns(ts, value))
    return grouped.select(key, F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")
