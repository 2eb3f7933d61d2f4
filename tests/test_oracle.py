"""Every registered query against its SQL, values compared exactly."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from palletwatch.plans import batch, oracle, stream
from tests.compare import assert_same, database
from tests.conftest import TESTDATA

KNOWN_ROWS = {
    "0.01": {
        "receipt_fact": 60000, "daily_receipts": 53307, "order_progress": 14743,
        "lead_time_stats": 100, "lead_time_quarantine": 29157, "late_receipts": 5, "repeated_keys": 11785,
        "latest_per_part": 2000, "rolling_quantity": 53307, "value_classes": 2000, "receipt_gaps": 51,
        "geography_totals": 131, "volume_anomalies": 20,
        "value_reconciliation": 15000, "hourly_events": 3385, "sliding_events": 2883, "dock_sessions": 5725,
        "unique_events": 10000, "hourly_events_stream": 3380, "dock_sessions_stream": 5660,
    },
    "0.001": {
        "receipt_fact": 6000, "daily_receipts": 5334, "order_progress": 1473,
        "lead_time_stats": 10, "lead_time_quarantine": 2815, "repeated_keys": 1161, "latest_per_part": 200,
        "receipt_gaps": 4, "geography_totals": 26, "volume_anomalies": 27,
        "value_reconciliation": 1500, "hourly_events": 868, "dock_sessions": 585,
    },
}


@pytest.mark.parametrize("sf", ["0.01", "0.001"])
@pytest.mark.parametrize("name", list(batch.batch_queries() | stream.stream_queries()))
def test_query_equals_sql(spark, name, sf):
    path = f"{TESTDATA}/sf{sf}"
    count = assert_same(entry_point.queries()[name](spark, path), name, database(path))
    assert count == KNOWN_ROWS[sf].get(name, count)


def test_every_query_has_sql():
    assert set(oracle.BATCH | oracle.STREAM) == set(batch.batch_queries() | stream.stream_queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5334
