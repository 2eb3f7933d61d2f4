"""Event counts in tumbling and sliding windows.

Both work on batch and streaming DataFrames alike; a stream needs a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Events per window and event type."""
    return (
        events.groupBy(F.window("ts", length).alias("span"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(
            F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
            "event_type", "events",
        )
    )


def sliding_counts(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Events per sliding window; ``length`` must be a multiple of ``slide``.

    Events are counted once per slide, and only those counts are copied into
    the windows that overlap them.
    """
    panes = events.groupBy(F.window("ts", slide).alias("pane")).agg(F.count("*").alias("n"))
    return (
        panes.groupBy(F.window("pane", length, slide).alias("span"))
        .agg(F.sum("n").alias("events"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "events")
    )
