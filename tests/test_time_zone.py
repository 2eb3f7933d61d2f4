"""Results do not depend on the time zone of the session, nor on daylight saving."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from tests.compare import assert_same, database
from tests.conftest import TESTDATA

PATH = f"{TESTDATA}/sf0.01"


@pytest.mark.parametrize(
    "name",
    ["open_orders", "daily_receipts", "volume_anomalies", "hourly_events", "sliding_events", "dock_sessions",
     "silent_docks", "hourly_events_stream"],
)
def test_other_time_zone(spark, settings, name):
    settings(spark__sql__session__timeZone="America/New_York")
    assert_same(entry_point.queries()[name](spark, PATH), name, database(PATH))
