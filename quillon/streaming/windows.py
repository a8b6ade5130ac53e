"""Event-time aggregates over change and event streams: tumbling, sliding and session windows with a watermark.

Beyond the change feed itself, whose late data is settled by clocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    rows = events if lateness is None else events.withWatermark(time, lateness)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(w, *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, lateness: str | None = None) -> DataFrame:
    rows = events if lateness is None else events.withWatermark(time, lateness)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
