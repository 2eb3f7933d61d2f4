"""Streaming source and sink for dock events, over files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palletwatch.session import fresh_dir, remove_dir, streaming_session
from palletwatch.sources.schemas import EVENTS

DELAY = "10 minutes"
BATCH_BYTES = 16 << 30  # of files in one batch, so that a backlog comes in steps
MAX_FILE_AGE = "36500d"


def event_stream(
    spark: SparkSession, path: str, delay: str = DELAY, files_per_batch: int | None = None,
    bytes_per_batch: int = BATCH_BYTES, max_file_age: str = MAX_FILE_AGE,
) -> DataFrame:
    """Dock events from the Parquet files of a folder or glob, with a watermark on ``ts``.

    The column is stored without a zone, which a watermark does not accept; it
    is read as UTC. The stream belongs to a session of its own (``streaming_session``).

    Files are taken in order of modification, at most ``files_per_batch`` or ``bytes_per_batch`` of them at a
    time; a backlog must have been written in order of time, or its older events are late. No file is
    passed over for its age: Spark's default leaves out what is a week older than the newest file seen. A shorter
    ``max_file_age`` also bounds the list of files that the query remembers.
    """
    reader = streaming_session(spark).readStream.schema(EVENTS).option("maxFileAge", max_file_age)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def start_files(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends the results of a stream to Parquet files, exactly once.

    Without ``every`` the query takes what is there, in as many batches as the
    source asks for, and stops.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def follow(query: StreamingQuery, seconds: float = 0.2) -> list[Mapping[str, Any]]:
    """Waits for a query to end and returns its progress reports, asking often enough to miss none.

    What a query keeps is bounded; ``late_events`` notices should a report be missing all the same.
    """
    reports: dict[tuple[int, str], Mapping[str, Any]] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(seconds)
        reports.update(((r["batchId"], r["timestamp"]), r) for r in query.recentProgress)
    return list(reports.values())


def watermark(progress: Iterable[Mapping[str, Any]]) -> dt.datetime | None:
    """The latest watermark of the reports, in UTC. Rows that end after it are withheld in append mode."""
    marks = [report["eventTime"]["watermark"] for report in progress if "watermark" in report["eventTime"]]
    return max((dt.datetime.fromisoformat(mark.replace("Z", "+00:00")).replace(tzinfo=None) for mark in marks), default=None)


def withheld(finished: DataFrame, end: str, reached: dt.datetime) -> DataFrame:
    """Rows of the same operator over the finished table that a stream has not given out at that watermark."""
    return finished.filter(F.col(end) > F.lit(reached.isoformat(sep=" ")).cast(finished.schema[end].dataType))


def run_to_end(
    df: DataFrame, spark: SparkSession | None = None, folder: str | None = None
) -> tuple[DataFrame, list[Mapping[str, Any]]]:
    """Runs a stream over all present input; returns its output, read by ``spark``, and its progress reports.

    Output and state stay in ``folder`` if it is given, and a later run goes on from there. Otherwise both are
    removed at once and the output is a checkpoint, which Spark deletes with its last reader.
    """
    spark = spark or df.sparkSession
    place = folder or fresh_dir(spark, "stream")
    reports = follow(start_files(df, f"{place}/out", f"{place}/state"))
    result = spark.read.schema(df.schema).parquet(f"{place}/out")
    if not folder:
        result = result.checkpoint()
        remove_dir(spark, place)
    return result, reports
