"""Sessions of activity per dock (``user_id`` stands in for the dock)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = dt.timedelta(hours=6)


def _interval(span: dt.timedelta) -> str:
    return f"{span // dt.timedelta(microseconds=1)} microseconds"


def activity_spells(events: DataFrame, length: dt.timedelta) -> DataFrame:
    """First event, last event and count per dock and stretch of ``length``.

    Two events of one stretch are less than ``length`` apart, so no pause of
    that length is lost, and a busy dock shrinks to a row per stretch on the
    map side.
    """
    return (
        events.groupBy("user_id", F.window("ts", _interval(length)).alias("stretch"))
        .agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("events"))
        .drop("stretch")
    )


def dock_sessions(events: DataFrame, gap: dt.timedelta = GAP) -> DataFrame:
    """Sessions closed by a pause longer than ``gap``, over a finished table."""
    by_time = Window.partitionBy("user_id").orderBy("first_event")
    pause = F.col("first_event") - F.lag("last_event").over(by_time)
    return (
        activity_spells(events, gap)
        .withColumn("opens", F.when(pause <= F.lit(gap), 0).otherwise(1))
        .withColumn("session", F.sum("opens").over(by_time))
        .groupBy("user_id", "session")
        .agg(
            F.min("first_event").alias("session_start"),
            (F.max("last_event") + F.lit(gap)).alias("session_end"),
            F.sum("events").alias("events"),
        )
        .drop("session")
    )


def dock_session_stream(events: DataFrame, gap: dt.timedelta = GAP) -> DataFrame:
    """The same sessions from a watermarked stream."""
    return (
        events.groupBy("user_id", F.session_window("ts", _interval(gap)).alias("span"))
        .agg(F.count("*").alias("events"))
        .select(
            "user_id", F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "events"
        )
    )
