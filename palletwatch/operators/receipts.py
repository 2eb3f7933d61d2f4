"""Receipt lines: the joined fact, daily volumes, repeats and the latest per part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import (
    PLACES,
    Places,
    as_decimal,
    net_places,
    net_units,
    order_day,
    quantity,
    receipt_day,
    total,
    total_quantity,
)

RECEIPT_KEY = ("l_orderkey", "l_linenumber")
# (l_orderkey, l_linenumber) repeats; with these and the part, a line is unique.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")


def with_vendor(receipts: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Receipts with the supplier, nation and region they came from.

    The three tables are joined to the receipts one by one. Joined to each other
    first, they look as large as the product of their sizes to the planner, which
    then shuffles all receipts for what could have been a broadcast.
    """
    return (
        receipts.join(supplier, receipts.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )


def receipt_fact(
    lineitem: DataFrame, orders: DataFrame, part: DataFrame,
    supplier: DataFrame, nation: DataFrame, region: DataFrame, places: Places = PLACES,
) -> DataFrame:
    """Each receipt line with its order, part, vendor and geography.

    No side is forced to broadcast: Spark does that below its size threshold and
    splits skewed keys of the shuffle joins beyond it.
    """
    ordered = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(
        part, lineitem.l_partkey == part.p_partkey
    )
    return with_vendor(ordered, supplier, nation, region).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        receipt_day().alias("receipt_day"),
        order_day().alias("order_day"),
        "o_orderpriority", "p_name", "p_brand", "s_name", "n_name", "r_name",
        quantity(places).alias("quantity"),
        as_decimal(net_units(places), net_places(places)).alias("net_value"),
    )


def daily_receipts(lineitem: DataFrame, places: Places = PLACES) -> DataFrame:
    """Lines, quantity and net value per supplier and day of receipt."""
    return lineitem.groupBy("l_suppkey", receipt_day().alias("receipt_day")).agg(
        F.count("*").alias("lines"),
        total_quantity(places).alias("quantity"),
        total(net_units(places), net_places(places)).alias("net_value"),
    )


def repeated_keys(lineitem: DataFrame, places: Places = PLACES) -> DataFrame:
    """Receipt keys booked more than once."""
    return (
        lineitem.groupBy(*RECEIPT_KEY)
        .agg(F.count("*").alias("times"), total_quantity(places).alias("quantity"))
        .filter("times > 1")
    )


def latest_per_part(lineitem: DataFrame, places: Places = PLACES) -> DataFrame:
    """The newest receipt of each part, ties going to the highest line key, then quantity.

    The maximum of a struct is an ordinary aggregate: each map task sends one
    row per part, however often that part was received. Spark sorts the lines of a
    task for it, since a struct is not kept in a hash aggregate's fixed-width buffer.
    """
    newest = F.max(F.struct(*LINE_ORDER, quantity(places).alias("quantity")))
    return (
        lineitem.groupBy("l_partkey")
        .agg(newest.alias("newest"))
        .select("l_partkey", "newest.*")
        .select("l_partkey", receipt_day().alias("receipt_day"), "l_orderkey", "l_linenumber", "l_suppkey", "quantity")
    )
