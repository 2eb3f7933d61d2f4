"""Receipt totals along region, nation and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import PLACES, Places, total_quantity
from palletwatch.operators.receipts import with_vendor


def geography_totals(
    lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame, places: Places = PLACES
) -> DataFrame:
    """Lines and quantity rolled up over region, nation and supplier, with grouping flags.

    A rollup copies each input row once per level, so it gets one row per
    supplier instead of the lines.
    """
    per_supplier = lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("lines"), total_quantity(places).alias("quantity")
    )
    return (
        with_vendor(per_supplier, supplier, nation, region)
        .rollup("r_name", "n_name", "l_suppkey")
        .agg(
            F.sum("lines").alias("lines"),
            F.sum("quantity").alias("quantity"),
            F.grouping("r_name").cast("bigint").alias("all_regions"),
            F.grouping("n_name").cast("bigint").alias("all_nations"),
            F.grouping("l_suppkey").cast("bigint").alias("all_suppliers"),
        )
    )
