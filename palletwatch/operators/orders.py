"""Purchase orders against their receipts: open orders, progress, value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import (
    PLACES,
    Places,
    as_decimal,
    net_places,
    net_units,
    order_day,
    receipt_day,
    tax_factor,
    total,
    total_quantity,
    units,
)


def open_orders(orders: DataFrame, lineitem: DataFrame, as_of: dt.date) -> DataFrame:
    """Orders placed by ``as_of`` without any receipt line by then, and how long they have been open.

    A line without a date of receipt has not been received. The order keys are made distinct
    first, on the map side, because an anti join cannot split a key that is frequent on its right.
    """
    received = lineitem.filter(receipt_day() <= F.lit(as_of)).select("l_orderkey").distinct()
    placed = orders.filter(order_day() <= F.lit(as_of))
    return placed.join(received, placed.o_orderkey == received.l_orderkey, "left_anti").select(
        "o_orderkey", "o_orderpriority",
        order_day().alias("order_day"),
        F.datediff(F.lit(as_of), order_day()).cast("bigint").alias("days_open"),
    )


def order_progress(lineitem: DataFrame, places: Places = PLACES) -> DataFrame:
    """Lines, quantity, first and last receipt of each order that has receipts."""
    return lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"),
        total_quantity(places).alias("quantity"),
        F.min(receipt_day()).alias("first_receipt"),
        F.max(receipt_day()).alias("last_receipt"),
    )


def value_reconciliation(
    orders: DataFrame, lineitem: DataFrame, tolerance: str = "0.01", places: Places = PLACES
) -> DataFrame:
    """Order totals against the summed value of their lines.

    Lines are summed per order before the join, which then meets one row per
    order on both sides and reuses the partitioning of that sum.
    """
    gross = total(net_units(places), net_places(places) + places["l_tax"], tax_factor(places))
    received = lineitem.groupBy("l_orderkey").agg(gross.alias("received_value"))
    difference = F.col("order_value") - F.col("received_value")
    return (
        orders.select("o_orderkey", as_decimal(units("o_totalprice", places), places["o_totalprice"]).alias("order_value"))
        .join(received, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_orderkey", "order_value", "received_value",
            difference.alias("difference"),
            F.when(F.col("l_orderkey").isNull(), "no receipt")
            .when(F.abs(difference) <= F.lit(tolerance).cast("decimal(12,2)"), "matched")
            .otherwise("differs")
            .alias("status"),
        )
    )
