"""Repeated dock events, and the late events a stream drops."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_events(events: DataFrame) -> DataFrame:
    """The first event of each id, over a finished table.

    The rank filter is pushed below the shuffle, so copies of one id are thinned
    out on the map side.
    """
    others = [column for column in events.columns if column not in ("event_id", "ts")]
    first = Window.partitionBy("event_id").orderBy("ts", *others)
    return events.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def unique_event_stream(events: DataFrame, spread: int = 1) -> DataFrame:
    """One event per id, where copies arrive within the watermark delay.

    With ``spread`` over 1, copies are first thinned out per id and input partition, so
    that an id with very many copies reaches its task in ``spread`` copies at most. That
    step keeps state of its own and shuffles all events once more; it is left out by
    default (README has timings). A checkpoint resumes only with the ``spread`` it was begun with.
    """
    if spread > 1:
        events = (
            events.withColumn("input_part", F.spark_partition_id() % spread)
            .dropDuplicatesWithinWatermark(["event_id", "input_part"])
            .drop("input_part")
        )
    return events.dropDuplicatesWithinWatermark(["event_id"])


def late_events(progress: Iterable[Mapping[str, Any]], first_batch: int = 0) -> int:
    """Events dropped as late, from all progress reports of a ``unique_event_stream`` query.

    Windowed aggregations drop rows that are already partly aggregated, so their
    count is not one of events; only de-duplication operators are read here.

    A query itself keeps its last ``spark.sql.streaming.numRecentProgressUpdates``
    reports; ``sources.stream.follow`` gathers them all. If the report of any batch since ``first_batch``
    (the first after a restart, whose earlier batches are not in the reports) is
    missing, that is an error, never a lower count.
    """
    batches: dict[int, Mapping[str, Any]] = {}
    for report in progress:
        if report["stateOperators"] or report["batchId"] not in batches:
            batches[report["batchId"]] = report
    missing = sorted(set(range(first_batch, max(batches, default=first_batch - 1) + 1)) - set(batches))
    if missing:
        raise ValueError(f"no progress report of {len(missing)} batches, the first being {missing[0]}")
    return sum(
        operator["numRowsDroppedByWatermark"]
        for report in batches.values()
        for operator in report["stateOperators"]
        if operator["operatorName"] == "dedupeWithinWatermark"
    )
