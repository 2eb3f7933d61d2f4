"""Value classes of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import PLACES, Places, total, units
from palletwatch.operators.ordered import running_total


def value_classes(
    lineitem: DataFrame, a_share: str = "0.80", b_share: str = "0.95", places: Places = PLACES
) -> DataFrame:
    """Parts by received value, in classes A, B and C.

    A part is in A while the parts before it have less than ``a_share`` of the
    whole value, in B while they have less than ``b_share``, else in C.
    """
    value = lineitem.groupBy("l_partkey").agg(total(units("l_extendedprice", places), places["l_extendedprice"]).alias("value"))
    ranked = running_total(value, "value", [F.desc("value"), F.asc("l_partkey")])

    # Sums widen to 38 digits; narrowed, the product with a share keeps all its places.
    before, overall = (F.col(name).cast(f"decimal(30,{places['l_extendedprice']})") for name in ("before", "overall"))

    def below(part_of_whole: str) -> Column:
        return before < overall * F.lit(part_of_whole).cast("decimal(3,2)")

    return ranked.select(
        "l_partkey", "value",
        before.alias("value_before"),
        F.when(below(a_share), "A").when(below(b_share), "B").otherwise("C").alias("value_class"),
    )
