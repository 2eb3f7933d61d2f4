"""Running totals and dense ranks over a whole table, without a single-task window.

The rows are range-partitioned once, so that slice i precedes slice i + 1. Each
slice is summed on its own; the handful of slice totals gives every slice its
starting value; a window inside the slice does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palletwatch.session import shared_dir


def running_total(df: DataFrame, amount: str, order: list[Column]) -> DataFrame:
    """Adds ``before``, the sum of ``amount`` over all earlier rows, and ``overall``.

    ``order`` must be total: include a unique column, both for a definite result
    and so that equal values can be spread over several slices.

    The sliced rows are checkpointed because range bounds come from a sample: a
    second evaluation could cut elsewhere and disagree with the first.
    """
    shared_dir(df.sparkSession)
    sliced = df.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()).checkpoint()

    # One row per slice, hence no more rows than shuffle partitions.
    all_slices = Window.orderBy("slice")
    starts = (
        sliced.groupBy("slice")
        .agg(F.sum(amount).alias("slice_total"))
        .select(
            "slice",
            (F.sum("slice_total").over(all_slices) - F.col("slice_total")).alias("slice_start"),
            F.sum("slice_total").over(all_slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias("overall"),
        )
    )
    earlier = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("in_slice", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
        .join(F.broadcast(starts), "slice")
        .withColumn("before", F.col("slice_start") + F.col("in_slice"))
        .drop("slice", "slice_start", "in_slice")
    )


def dense_rank_desc(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the dense rank of ``value``, highest first; NULL values get no rank.

    Ranks are found over the distinct values and joined back, so a value shared
    by many rows is ranked once and its rows never meet in one window.
    """
    distinct = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("ranked")).distinct()
    ranks = running_total(distinct.withColumn("one", F.lit(1)), "one", [F.desc("ranked")]).select(
        "ranked", (F.col("before") + 1).alias(name)
    )
    return df.join(ranks, F.col(value) == F.col("ranked"), "left").drop("ranked")
