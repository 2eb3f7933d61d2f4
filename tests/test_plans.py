"""What Spark makes of the operators: no cross joins, no Python, narrow scans, pushed filters."""

from __future__ import annotations

import re

import pytest

from palletwatch.operators.leadtime import late_receipts
from palletwatch.operators.receipts import daily_receipts, latest_per_part
from palletwatch.operators.orders import open_orders, order_progress, value_reconciliation
from palletwatch.operators.series import receipt_gaps
from palletwatch.plans.batch import AS_OF, batch_queries
from palletwatch.sources.tables import Tables
from palletwatch.streaming.sessions import dock_sessions
from tests.conftest import TESTDATA


@pytest.fixture
def no_broadcast(settings):
    """Plans as they are once no table is small enough to broadcast."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


@pytest.fixture
def tables(spark):
    return Tables(spark, f"{TESTDATA}/sf0.01")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.mark.parametrize("name", list(batch_queries()))
def test_no_cross_join_no_python_no_single_task(spark, no_broadcast, name):
    text = plan(batch_queries()[name](spark, f"{TESTDATA}/sf0.01"))
    assert not re.search(r"CartesianProduct|NestedLoop|Python|InPandas|InArrow", text)
    # One task may see: a single aggregated row, one row per slice, one row per calendar day.
    single = text.count("Exchange SinglePartition")
    allowed = {
        "supplier_scorecard": 2, "value_classes": 1, "volume_anomalies": 1, "rule_violations": 5,
        "empty_days_by_region": 2, "empty_days_by_supplier": 2,
    }
    assert single <= allowed.get(name, 0)


@pytest.mark.parametrize(
    ("operator", "expected"),
    [
        (lambda t: daily_receipts(t.lineitem), 1),
        (lambda t: order_progress(t.lineitem), 1),
        (lambda t: latest_per_part(t.lineitem), 1),
        (lambda t: open_orders(t.orders, t.lineitem, AS_OF), 2),
        (lambda t: value_reconciliation(t.orders, t.lineitem), 2),
        (lambda t: late_receipts(t.lineitem, t.orders), 3),
        (lambda t: receipt_gaps(t.lineitem), 2),
        (lambda t: dock_sessions(t.events), 2),
    ],
)
def test_number_of_shuffles(tables, no_broadcast, operator, expected):
    assert shuffles(operator(tables)) == expected


def test_scan_reads_only_needed_columns(tables):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan(receipt_gaps(tables.lineitem))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_shipdate"}


def test_filters_reach_the_scan(tables, settings):
    settings(spark__sql__maxMetadataStringLength="2000")
    filtered = daily_receipts(tables.lineitem.filter("l_shipdate >= timestamp_ntz'2000-01-01'")).filter("l_suppkey = 7")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(filtered)).group(1)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "EqualTo(l_suppkey,7)" in pushed


@pytest.mark.parametrize("operator", [daily_receipts, order_progress, latest_per_part])
def test_rows_are_combined_before_the_shuffle(tables, operator):
    text = plan(operator(tables.lineitem))
    assert "partial_" in text[text.index("Exchange"):]
