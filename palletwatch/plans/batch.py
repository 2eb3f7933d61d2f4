"""Batch operators over whole tables, under the names they are registered by."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palletwatch.operators import geography, leadtime, orders, parts, quality, receipts, series, suppliers
from palletwatch.sources.tables import Tables
from palletwatch.streaming import dedupe, sessions, silence, windows

# Inside the range of the data, so that what comes later matters.
AS_OF = dt.date(1997, 6, 30)
EVENTS_AS_OF = dt.datetime(2024, 1, 20)

Query = Callable[[SparkSession, str], DataFrame]

OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {
    "receipt_fact": lambda t: receipts.receipt_fact(t.lineitem, t.orders, t.part, t.supplier, t.nation, t.region),
    "daily_receipts": lambda t: receipts.daily_receipts(t.lineitem),
    "open_orders": lambda t: orders.open_orders(t.orders, t.lineitem, AS_OF),
    "order_progress": lambda t: orders.order_progress(t.lineitem),
    "lead_time_stats": lambda t: leadtime.lead_time_stats(t.lineitem, t.orders),
    "suggested_limits": lambda t: leadtime.suggest_limits(t.lineitem, t.orders),
    "lead_time_quarantine": lambda t: leadtime.lead_time_quarantine(t.lineitem, t.orders),
    "late_receipts": lambda t: leadtime.late_receipts(t.lineitem, t.orders),
    "supplier_scorecard": lambda t: suppliers.supplier_scorecard(t.lineitem, t.orders),
    "repeated_keys": lambda t: receipts.repeated_keys(t.lineitem),
    "latest_per_part": lambda t: receipts.latest_per_part(t.lineitem),
    "rolling_quantity": lambda t: series.rolling_quantity(t.lineitem),
    "value_classes": lambda t: parts.value_classes(t.lineitem),
    "receipt_gaps": lambda t: series.receipt_gaps(t.lineitem),
    "geography_totals": lambda t: geography.geography_totals(t.lineitem, t.supplier, t.nation, t.region),
    "empty_days_by_region": lambda t: series.empty_days_by_region(t.lineitem, t.supplier, t.nation, t.region),
    "empty_days_by_supplier": lambda t: series.empty_days_by_supplier(t.lineitem, t.supplier),
    "volume_anomalies": lambda t: series.volume_anomalies(t.lineitem),
    "value_reconciliation": lambda t: orders.value_reconciliation(t.orders, t.lineitem),
    "rule_violations": lambda t: quality.rule_violations(t.lineitem, t.orders, t.part, t.supplier),
    "hourly_events": lambda t: windows.hourly_counts(t.events),
    "sliding_events": lambda t: windows.sliding_counts(t.events),
    "dock_sessions": lambda t: sessions.dock_sessions(t.events),
    "unique_events": lambda t: dedupe.unique_events(t.events),
    "silent_docks": lambda t: silence.silent_docks(t.events, EVENTS_AS_OF),
}


def flat_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles, converted after all sums, so that results compare across engines."""
    return df.select(
        *(
            F.col(field.name).cast("double").alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(field.name)
            for field in df.schema
        )
    )


def _query(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, path: flat_types(operator(Tables(spark, path)))


def batch_queries() -> dict[str, Query]:
    return {name: _query(operator) for name, operator in OPERATORS.items()}
