"""Alerts for docks (``user_id``) that send no event for some time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palletwatch.streaming.sessions import activity_spells, dock_session_stream

LIMIT = dt.timedelta(hours=24)


def silent_docks(events: DataFrame, as_of: dt.datetime, limit: dt.timedelta = LIMIT) -> DataFrame:
    """Every silence longer than ``limit``, over a finished table.

    One row per silence: the last event before it and the moment it became one.
    A silence that still lasts counts up to ``as_of``; later events are not yet known.
    """
    by_time = Window.partitionBy("user_id").orderBy("first_event")
    end = F.lit(as_of.isoformat(sep=" ")).cast(events.schema["ts"].dataType)
    return (
        activity_spells(events.filter(F.col("ts") <= end), limit)
        .withColumn("next_event", F.coalesce(F.lead("first_event").over(by_time), end))
        .filter(F.col("next_event") - F.col("last_event") > F.lit(limit))
        .select("user_id", "last_event", (F.col("last_event") + F.lit(limit)).alias("alert_at"))
    )


def silent_dock_stream(events: DataFrame, limit: dt.timedelta = LIMIT) -> DataFrame:
    """The same alerts from a watermarked stream, raised while the dock is still silent.

    A session with ``limit`` as its gap ends where a silence becomes too long,
    and append mode gives it out as soon as the watermark gets there. That takes
    the place of a timer per dock: the state stays in the JVM and the sessions
    of a busy dock are merged before the shuffle.
    """
    return dock_session_stream(events, limit).select(
        "user_id",
        (F.col("session_end") - F.lit(limit)).alias("last_event"),
        F.col("session_end").alias("alert_at"),
    )
