"""Rules that receipt lines must meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwatch.functions.columns import PLACES, Places, count_if, finer

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def row_rules(lineitem: DataFrame, places: Places = PLACES) -> DataFrame:
    """Violations that a line shows by itself: one scan, one row per rule."""
    checks = {f"null {key}": F.col(key).isNull() for key in KEYS}
    checks["quantity not positive"] = F.col("l_quantity") <= 0
    checks["discount outside 0 to 1"] = ~F.col("l_discount").between(0, 1)
    for amount in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        checks[f"{amount} finer than {places[amount]} places"] = finer(amount, places)
    counted = lineitem.agg(*(count_if(check).alias(rule) for rule, check in checks.items()))
    return counted.unpivot([], list(checks), "rule", "violations")


def orphan_rule(lineitem: DataFrame, line_key: str, owner: DataFrame, owner_key: str) -> DataFrame:
    """Lines whose key is missing from the owning table.

    Lines are counted per key first, so the anti join meets each key once.
    """
    per_key = lineitem.filter(F.col(line_key).isNotNull()).groupBy(line_key).agg(F.count("*").alias("n"))
    return (
        per_key.join(owner, F.col(line_key) == F.col(owner_key), "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        .select(F.lit(f"orphan {line_key}").alias("rule"), "violations")
    )


def rule_violations(
    lineitem: DataFrame, orders: DataFrame, part: DataFrame, supplier: DataFrame, places: Places = PLACES
) -> DataFrame:
    """One row per rule with the number of lines, for the last one orders, that break it."""
    orphans = (
        orphan_rule(lineitem, "l_orderkey", orders, "o_orderkey"),
        orphan_rule(lineitem, "l_partkey", part, "p_partkey"),
        orphan_rule(lineitem, "l_suppkey", supplier, "s_suppkey"),
    )
    fine = orders.agg(count_if(finer("o_totalprice", places)).alias("violations")).select(
        F.lit(f"o_totalprice finer than {places['o_totalprice']} places").alias("rule"), "violations"
    )
    return reduce(DataFrame.unionByName, (*orphans, fine), row_rules(lineitem, places))
