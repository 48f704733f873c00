"""Keeping the last event of each burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, time: str, value: str, gap: str = "150 milliseconds", watermark: str | None = None) -> DataFrame:
    """``key, start, end, last_value, n``: a burst ends when a key is silent for ``gap``.

    Works on batch frames and, with a watermark, on streams.  Sessions are
    merged before and after the shuffle, so that a busy key isn't collected.
    """
    rows = events if watermark is None else events.withWatermark(time, watermark)
    burst = rows.groupBy(key, F.session_window(time, gap).alias("w"))
    return burst.agg(F.max_by(value, time).alias("last_value"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "last_value", "n")
