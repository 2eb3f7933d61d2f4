"""Streams against the same operators over the finished table, and late data."""

from __future__ import annotations

import datetime as dt
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palletwatch import session
from palletwatch.plans.stream import zoneless
from palletwatch.sources.stream import event_stream, follow, run_to_end, start_files, watermark, withheld
from palletwatch.streaming import dedupe, sessions, silence, windows
from tests.fixtures import events, rows

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes batches of events, one file each, in the order a stream will read them."""

    def write(*batches):
        folder = str(tmp_path / "events")
        for batch in batches:
            events(spark, *batch).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(1.1)  # files are read in order of their modification time
        return folder

    return write


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def shuffled_events(count, docks, seed, hot=0.0):
    """Events in time order; a share ``hot`` of them come from dock 0."""
    rng = random.Random(seed)
    minute, out = 0, []
    for n in range(count):
        minute += rng.choice([0, 1, 5, 30, 400])
        out.append((n, minute, 0 if rng.random() < hot else rng.randrange(docks)))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_batch_sessions_equal_session_window(spark, hot):
    table = events(spark, *shuffled_events(600, 5, 3, hot))
    spark_own = (
        table.groupBy("user_id", F.session_window("ts", "6 hours").alias("span"))
        .agg(F.count("*").alias("events")).select("user_id", "span.start", "span.end", "events")
    )
    assert rows(sessions.dock_sessions(table)) == rows(spark_own)


def test_sessions_at_the_exact_gap(spark):
    """A pause of exactly the gap still belongs to the session."""
    table = events(spark, (1, 0, 1), (2, 360, 1), (3, 721, 1))
    assert rows(sessions.dock_sessions(table), "session_start", "events") == [(at(0), 2), (at(721), 1)]


def test_silence_at_the_exact_limit_and_at_the_end(spark):
    table = events(spark, (1, 0, 1), (2, 24 * 60, 1), (3, 48 * 60 + 1, 1), (4, 0, 2))
    got = silence.silent_docks(table, at(48 * 60 + 2))
    assert rows(got) == [
        (1, at(24 * 60), at(48 * 60)), (2, at(0), at(24 * 60)),
    ]


def test_sliding_counts_equal_direct_windows(spark):
    table = events(spark, *shuffled_events(500, 3, 4))
    direct = (
        table.groupBy(F.window("ts", "1 hour", "15 minutes").alias("span"))
        .agg(F.count("*").alias("events")).select("span.start", "span.end", "events")
    )
    assert rows(windows.sliding_counts(table)) == rows(direct)


def test_unique_events_keeps_the_first_copy(spark):
    table = events(spark, (1, 5, 1), (1, 2, 1), (1, 9, 1), (2, 0, 1))
    assert rows(dedupe.unique_events(table), "event_id", "ts") == [(1, at(2)), (2, at(0))]


STREAM_AND_BATCH = {
    "hourly": (windows.hourly_counts, windows.hourly_counts, "window_end"),
    "sliding": (windows.sliding_counts, windows.sliding_counts, "window_end"),
    "sessions": (sessions.dock_session_stream, sessions.dock_sessions, "session_end"),
    "silence": (silence.silent_dock_stream, lambda t: silence.silent_docks(t, dt.datetime(2099, 1, 1)), "alert_at"),
}


@pytest.mark.parametrize("name", list(STREAM_AND_BATCH))
def test_stream_in_batches_equals_finished_table(spark, arrivals, name):
    """Time-ordered arrival in four batches gives what the watermark has passed."""
    on_stream, on_table, end = STREAM_AND_BATCH[name]
    all_events = shuffled_events(200, 4, 5, 0.4)
    folder = arrivals(*(all_events[n:n + 50] for n in range(0, 200, 50)))
    result, reports = run_to_end(on_stream(event_stream(spark, folder, files_per_batch=1)))
    reached = at(all_events[-1][1] - 10)
    finished = on_table(spark.read.parquet(folder))
    expected = finished.filter(F.col(end) <= F.lit(str(reached)).cast("timestamp_ntz"))
    assert watermark(reports) == reached
    assert withheld(finished, end, watermark(reports)).count() == finished.count() - expected.count()
    assert len([p for p in reports if p["numInputRows"]]) == 4
    assert rows(zoneless(result)) == rows(expected) != []


def test_stream_drops_and_counts_late_events(spark, arrivals):
    """Three late events of one window and dock, after the watermark has moved on."""
    folder = arrivals(
        [(1, 0, 1), (2, 5, 1)],
        [(3, 120, 1)],
        [(4, 125, 1)],
        [(5, 1, 1), (6, 2, 1), (7, 3, 1), (8, 126, 1)],
    )
    result, reports = run_to_end(dedupe.unique_event_stream(event_stream(spark, folder, files_per_batch=1)))
    assert rows(result, "event_id") == [(1,), (2,), (3,), (4,), (8,)]
    assert dedupe.late_events(reports) == 3

    counts, reports = run_to_end(windows.hourly_counts(event_stream(spark, folder, files_per_batch=1)))
    assert rows(zoneless(counts), "window_start", "events") == [(at(0), 2)]
    assert dedupe.late_events(reports) == 0


def test_stream_removes_copies_within_and_across_batches(spark, arrivals):
    """A third of all events are copies of one id, spread over files and partitions."""
    folder = arrivals(
        [(1, 0, 1)] * 40 + [(n, 1, 1) for n in range(2, 80)],
        [(1, 2, 1)] * 40 + [(n, 3, 1) for n in range(80, 160)],
    )
    for per_batch in (1, 2):
        result, reports = run_to_end(dedupe.unique_event_stream(event_stream(spark, folder, files_per_batch=per_batch)))
        assert rows(result, "event_id") == [(n,) for n in range(1, 160)]
        assert dedupe.late_events(reports) == 0


def test_stopped_stream_continues_from_its_checkpoint(spark, arrivals, tmp_path):
    """New files are added to earlier results without repeating them."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    folder = arrivals([(1, 0, 1), (1, 1, 1), (2, 1, 1)])
    start_files(dedupe.unique_event_stream(event_stream(spark, folder)), out, state).awaitTermination()
    arrivals([(2, 2, 1), (3, 3, 1)])
    start_files(dedupe.unique_event_stream(event_stream(spark, folder)), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == [(1,), (2,), (3,)]


def test_a_backfill_of_old_files_is_read(spark, arrivals, tmp_path):
    """Spark's own default passes over a file that is a week older than the newest one seen."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    folder = arrivals([(1, 0, 1)])
    run = lambda: start_files(
        dedupe.unique_event_stream(event_stream(spark, folder)), out, state
    ).awaitTermination()
    run()
    before = set(Path(folder).glob("*.parquet"))
    arrivals([(2, 1, 1)])
    old = time.time() - 10 * 86400
    for file in set(Path(folder).glob("*.parquet")) - before:
        os.utime(file, (old, old))
    arrivals([(3, 2, 1)])
    run()
    assert rows(spark.read.parquet(out), "event_id") == [(1,), (2,), (3,)]


def test_late_events_are_counted_beyond_the_reports_a_query_keeps(spark, settings, arrivals, tmp_path):
    settings(spark__sql__streaming__numRecentProgressUpdates="3")
    folder = arrivals([(1, 120, 1)], [(2, 125, 1)], [(3, 1, 1), (4, 2, 1)], *([(10 + n, 126 + n, 1)] for n in range(5)))
    stream = dedupe.unique_event_stream(event_stream(spark, folder, files_per_batch=1))
    query = start_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    reports = follow(query, 0.05)
    assert len(query.recentProgress) <= 3 and len(reports) >= 8
    assert dedupe.late_events(reports) == 2
    with pytest.raises(ValueError, match="no progress report"):
        dedupe.late_events(query.recentProgress)


def test_restart_with_another_number_of_partitions(spark, settings, arrivals, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    folder = arrivals([(1, 0, 1), (2, 1, 1)])
    start_files(dedupe.unique_event_stream(event_stream(spark, folder)), out, state).awaitTermination()
    settings(spark__sql__shuffle__partitions="1")
    arrivals([(2, 2, 1), (3, 3, 1)])
    start_files(dedupe.unique_event_stream(event_stream(spark, folder)), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == [(1,), (2,), (3,)]


def test_thinned_copies_give_the_same_events(spark, arrivals):
    folder = arrivals([(1, 0, 1)] * 40 + [(n, 1, 1) for n in range(2, 80)])
    result, _ = run_to_end(dedupe.unique_event_stream(event_stream(spark, folder), spread=4))
    assert rows(result, "event_id") == [(n,) for n in range(1, 80)]


@pytest.mark.parametrize("gap", [dt.timedelta(seconds=1.5), dt.timedelta(seconds=0.5)])
def test_gaps_below_a_second(spark, gap):
    table = events(spark, (1, 0, 1), (2, 1.2 / 60, 1), (3, 2.9 / 60, 1))
    own = (
        table.groupBy("user_id", F.session_window("ts", f"{gap.total_seconds()} seconds").alias("span"))
        .agg(F.count("*").alias("events")).select("user_id", "span.start", "span.end", "events")
    )
    assert rows(sessions.dock_sessions(table, gap)) == rows(own)


def test_silence_as_of_a_moment_knows_nothing_later(spark):
    day = 24 * 60
    table = events(spark, (1, 0, 1), (2, 20 * day, 1), (3, 40 * day, 1))
    assert rows(silence.silent_docks(table, at(5 * day))) == [(1, at(0), at(day))]


def test_the_callers_session_and_folders_stay_as_they_are(spark, settings, arrivals):
    settings(spark__sql__session__timeZone="America/New_York")
    before = spark.conf.getAll
    folder = arrivals([(1, 0, 1), (2, 900, 1)])
    shared = Path(session.shared_dir(spark).removeprefix("file:"))
    result, _ = run_to_end(zoneless(windows.hourly_counts(event_stream(spark, folder))), spark)
    assert rows(result, "window_start", "events") == [(at(0), 1)]
    assert spark.conf.getAll == before
    assert not list(shared.glob("stream-*"))


def test_results_stay_in_a_named_folder(spark, arrivals, tmp_path):
    folder = arrivals([(1, 0, 1)])
    place = str(tmp_path / "mine")
    run_to_end(dedupe.unique_event_stream(event_stream(spark, folder)), folder=place)
    arrivals([(1, 1, 1), (2, 1, 1)])
    result, _ = run_to_end(dedupe.unique_event_stream(event_stream(spark, folder)), folder=place)
    assert rows(result, "event_id") == [(1,), (2,)]
