"""Receipts along the calendar: rolling sums, gaps, empty days and anomalies.

Every operator here reduces the lines to one row per day, or per supplier and
day, before it looks at neighbouring days. A window partition is therefore no
longer than the calendar, whatever the volume of a supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palletwatch.functions.columns import PLACES, Places, as_decimal, receipt_day, total_quantity, units
from palletwatch.operators.receipts import with_vendor


def _supplier_days(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_suppkey", receipt_day().alias("receipt_day")).distinct()


def rolling_quantity(lineitem: DataFrame, days: int = 7, places: Places = PLACES) -> DataFrame:
    """Quantity of the day and the days before it, ``days`` calendar days in all, per supplier."""
    recent = Window.partitionBy("l_suppkey").orderBy(F.unix_date("receipt_day")).rangeBetween(1 - days, 0)
    return (
        lineitem.groupBy("l_suppkey", receipt_day().alias("receipt_day"))
        .agg(F.sum(units("l_quantity", places)).alias("units"))
        .select(
            "l_suppkey", "receipt_day",
            as_decimal(F.col("units"), places["l_quantity"]).alias("quantity"),
            as_decimal(F.sum("units").over(recent), places["l_quantity"]).alias("rolling_quantity"),
        )
    )


def receipt_gaps(lineitem: DataFrame, more_than: int = 30) -> DataFrame:
    """Stretches of more than ``more_than`` days between consecutive receipts of a supplier."""
    by_day = Window.partitionBy("l_suppkey").orderBy("receipt_day")
    return (
        _supplier_days(lineitem)
        .withColumn("previous_day", F.lag("receipt_day").over(by_day))
        .withColumn("gap_days", F.datediff("receipt_day", "previous_day").cast("bigint"))
        .filter(F.col("gap_days") > more_than)
        .select("l_suppkey", "previous_day", "receipt_day", "gap_days")
    )


def _empty_days(lineitem: DataFrame, seen: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Stretches of days, between the first and last receipt of all, on which a member of ``key`` is not ``seen``.

    No day is generated: each member gets a mark just outside either end, and what
    lies between neighbouring rows is a stretch. There are at most as many as days
    seen and members. Rows of unknown members have no mark before them and are left out.
    """
    first = lineitem.agg(F.date_sub(F.min(receipt_day()), 1)).scalar()
    last = lineitem.agg(F.date_add(F.max(receipt_day()), 1)).scalar()
    ends = members.select(key, F.explode(F.array(first, last)).alias("receipt_day"), F.lit(True).alias("mark"))
    by_day = Window.partitionBy(key).orderBy("receipt_day")
    return (
        seen.select(key, "receipt_day", F.lit(False).alias("mark"))
        .filter("receipt_day IS NOT NULL")
        .unionByName(ends)
        .withColumn("next_day", F.lead("receipt_day").over(by_day))
        .withColumn("is_member", F.first("mark").over(by_day))
        .filter(F.col("is_member") & (F.datediff("next_day", "receipt_day") > 1))
        .select(
            key,
            F.date_add("receipt_day", 1).alias("first_day"),
            F.date_sub("next_day", 1).alias("last_day"),
            (F.datediff("next_day", "receipt_day") - 1).cast("bigint").alias("days"),
        )
    )


def empty_days_by_region(
    lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Stretches of days without any receipt per region.

    Lines meet the vendor tables first: distinct regions and days are so few that
    little is left to shuffle after that, while supplier days are almost as many
    as lines.
    """
    seen = (
        with_vendor(lineitem, supplier, nation, region)
        .select("r_name", receipt_day().alias("receipt_day"))
        .distinct()
    )
    return _empty_days(lineitem, seen, region, "r_name")


def empty_days_by_supplier(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Stretches of days without any receipt per supplier."""
    members = supplier.select(F.col("s_suppkey").alias("l_suppkey"))
    return _empty_days(lineitem, _supplier_days(lineitem), members, "l_suppkey")


def volume_anomalies(
    lineitem: DataFrame, *by: str, history: int = 28, threshold: float = 3.0, places: Places = PLACES
) -> DataFrame:
    """Days whose quantity is far from the ``history`` receipt days before it.

    Days with less history, or with a history of equal quantities, have no z
    score and are not reported. Without ``by`` there is one series for all
    receipts, a row per calendar day.
    """
    daily = lineitem.groupBy(*by, receipt_day().alias("receipt_day")).agg(total_quantity(places).alias("quantity"))
    before = Window.partitionBy(*by).orderBy("receipt_day").rowsBetween(-history, -1)
    amount = F.col("quantity").cast("double")
    return (
        daily.withColumn("days_before", F.count("*").over(before))
        .withColumn("mean", F.avg(amount).over(before))
        .withColumn("deviation", F.stddev_samp(amount).over(before))
        .withColumn("z", F.try_divide(amount - F.col("mean"), F.col("deviation")))
        .filter((F.col("days_before") == history) & (F.abs("z") > threshold))
        .select(*by, "receipt_day", "quantity", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "z")))
    )
