"""Streaming forms (an extension): activity in event time.

Both need a watermark, so state stays bounded: what is later than it is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def talk_sessions(events: DataFrame, gap: str, lateness: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Merged stretches of activity: events closer than ``gap`` belong together."""
    got = events.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def frame_counts(events: DataFrame, length: str, shift: str, lateness: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Events in each sliding frame; frames are aligned to the epoch."""
    got = events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, length, shift).alias("w")).agg(F.count("*").alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
