"""Days from order to receipt: statistics, impossible dates and lateness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import count_if, lead_days, lookup, order_day, receipt_day, share

# Days allowed from order to receipt; an invented default, see suggest_limits.
DEFAULT_LIMITS = {"1-URGENT": 30, "2-HIGH": 60, "3-MEDIUM": 90, "4-NOT SPECIFIED": 120, "5-LOW": 120}


def with_lead(lineitem: DataFrame, orders: DataFrame, how: str = "inner") -> DataFrame:
    """Receipt lines with the priority and lead time of their order; a left join keeps lines of unknown orders."""
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, how).withColumn("lead", lead_days())


def _spread(leads: DataFrame, key: str, counted: bool = False) -> DataFrame:
    """Exact quantiles of lead time per key, interpolated and given to six places.

    ``percentile`` counts equal values on the map side, so a key brings as many
    entries to the shuffle as it has distinct numbers of days, not lines. Where keys are
    few, ``counted`` counts lines per key and number of days first: those counts are spread over all
    tasks, and what reaches a key does not grow with the number of map tasks.
    """
    leads = leads.filter("lead >= 0")
    lines, times = F.count("*"), F.lit(1)
    if counted:
        leads = leads.groupBy(key, "lead").agg(F.count("*").alias("times"))
        lines, times = F.sum("times"), F.col("times")
    return (
        leads.groupBy(key)
        .agg(
            lines.alias("lines"),
            F.min("lead").alias("min_lead"),
            F.percentile("lead", F.array(F.lit(0.5), F.lit(0.9)), times).alias("quantiles"),
            F.max("lead").alias("max_lead"),
        )
        .select(
            key, "lines", "min_lead",
            F.round(F.col("quantiles")[0], 6).alias("median_lead"),
            F.round(F.col("quantiles")[1], 6).alias("p90_lead"),
            "max_lead",
        )
    )


def lead_time_stats(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Lead time per supplier, receipts dated before their order left out."""
    return _spread(with_lead(lineitem, orders), "l_suppkey")


def suggest_limits(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Lead time per order priority, from which to choose the limits of late_receipts."""
    return _spread(with_lead(lineitem, orders), "o_orderpriority", counted=True)


def lead_time_quarantine(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Receipt lines dated before their order."""
    return (
        with_lead(lineitem, orders)
        .filter("lead < 0")
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            order_day().alias("order_day"), receipt_day().alias("receipt_day"), "lead",
        )
    )


def is_late(limits: Mapping[str, int]) -> Column:
    """True beyond the limit of the priority, NULL where lateness is not defined."""
    return F.when(F.col("lead") >= 0, F.col("lead") > lookup(limits, "o_orderpriority"))


def late_receipts(lineitem: DataFrame, orders: DataFrame, limits: Mapping[str, int] = DEFAULT_LIMITS) -> DataFrame:
    """Lines and late lines per order priority."""
    return (
        with_lead(lineitem, orders)
        .filter("lead >= 0")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("lines"), count_if(is_late(limits)).alias("late_lines"))
        .withColumn("late_share", share("late_lines", "lines"))
    )
