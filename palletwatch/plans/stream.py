"""Streaming operators run over the whole events table until it is used up.

A stream in append mode gives out only what its watermark has passed, so the
newest windows stay open and are not part of these results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwatch.sources.stream import event_stream, run_to_end
from palletwatch.streaming import dedupe, sessions, silence, windows

# A stream takes a folder or a glob, never one file; this matches either.
EVENTS_GLOB = "events.[p]arquet"

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hourly_events_stream": windows.hourly_counts,
    "sliding_events_stream": windows.sliding_counts,
    "dock_sessions_stream": sessions.dock_session_stream,
    "unique_events_stream": dedupe.unique_event_stream,
    "silent_docks_stream": silence.silent_dock_stream,
}


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the events table has them."""
    return df.select(
        *(
            F.col(field.name).cast("timestamp_ntz").alias(field.name)
            if isinstance(field.dataType, T.TimestampType)
            else F.col(field.name)
            for field in df.schema
        )
    )


def _query(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, path: str) -> DataFrame:
        result, _ = run_to_end(zoneless(operator(event_stream(spark, f"{path}/{EVENTS_GLOB}"))), spark)
        return result

    return run


def late_event_report(spark: SparkSession, path: str) -> DataFrame:
    """Events taken by the de-duplication stream, and how many it dropped as late."""
    events = dedupe.unique_event_stream(event_stream(spark, f"{path}/{EVENTS_GLOB}"))
    result, reports = run_to_end(events.select("event_id"), spark)
    late = dedupe.late_events(reports)
    return result.agg(F.count("*").alias("events")).withColumn("late", F.lit(late).cast("bigint"))


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(operator) for name, operator in OPERATORS.items()} | {
        "late_event_report": late_event_report
    }
