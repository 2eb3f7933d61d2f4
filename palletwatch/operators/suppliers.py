"""Supplier scorecard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import count_if, share
from palletwatch.operators.leadtime import DEFAULT_LIMITS, is_late, with_lead
from palletwatch.operators.ordered import dense_rank_desc
from palletwatch.session import shared_dir


def supplier_scorecard(
    lineitem: DataFrame, orders: DataFrame, limits: Mapping[str, int] = DEFAULT_LIMITS
) -> DataFrame:
    """Share of returned and of late lines per supplier, each ranked with the worst first.

    The late share counts only lines for which lateness is defined, so not those of an
    unknown order, which still count as lines and as returned. The scores,
    one row per supplier, are checkpointed: both rankings read them again, and
    the join below them should run once.
    """
    shared_dir(lineitem.sparkSession)
    late = is_late(limits)
    scores = (
        with_lead(lineitem, orders, "left")
        .groupBy("l_suppkey")
        .agg(
            F.count("*").alias("lines"),
            count_if(F.col("l_returnflag") == "R").alias("returned_lines"),
            count_if(F.col("lead") >= 0).alias("eligible_lines"),
            count_if(late).alias("late_lines"),
        )
        .withColumn("returned_share", share("returned_lines", "lines"))
        .withColumn("late_share", share("late_lines", "eligible_lines"))
        .checkpoint()
    )
    ranked = dense_rank_desc(scores, "returned_share", "returned_rank")
    return dense_rank_desc(ranked, "late_share", "late_rank")
