"""Money, dates and shares as column expressions.

A sum of doubles depends on the order in which partitions arrive, so amounts
are summed as whole units of their last declared place, finer once rates are multiplied in.
Sums of longs keep the aggregation in plain fixed-width buffers; the decimal is
made once per group, from the finished sum.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_BITS = 20

# Decimal places that each column is read with; pass another mapping to the operators
# to read more. rule_violations counts values that are finer than declared.
PLACES = {"l_quantity": 3, "l_extendedprice": 2, "l_discount": 4, "l_tax": 4, "o_totalprice": 2}

Places = Mapping[str, int]


def units(amount: str, places: Places = PLACES) -> Column:
    """A column as a whole number of its last declared place."""
    return F.rint(F.col(amount) * 10 ** places[amount]).cast("bigint")


def finer(amount: str, places: Places = PLACES) -> Column:
    """True for values that ``units`` would round."""
    return F.col(amount) != F.round(F.col(amount), places[amount])


def net_places(places: Places = PLACES) -> int:
    return places["l_extendedprice"] + places["l_discount"]


def net_units(places: Places = PLACES) -> Column:
    """Line price after discount, in units of its last place."""
    return units("l_extendedprice", places) * (10 ** places["l_discount"] - units("l_discount", places))


def tax_factor(places: Places = PLACES) -> Column:
    """One and the tax rate, in units of the rate's last place."""
    return 10 ** places["l_tax"] + units("l_tax", places)


def _unit(places: int) -> Column:
    return F.lit(f"0.{'1'.zfill(places)}" if places else "1").cast(f"decimal({max(places, 1)},{places})")


def as_decimal(amount: Column, places: int) -> Column:
    """Whole units as a decimal of that many places."""
    return (amount.cast("decimal(18,0)") * _unit(places)).cast(f"decimal(18,{places})")


def total(amount: Column, places: int, factor: Column | int = 1) -> Column:
    """The exact sum of whole units, each times ``factor``, as a decimal.

    High and low bits are added apart: a long holds either sum for trillions of
    rows, where the plain sum of finely scaled values would run over.
    """
    high = F.sum(F.shiftright(amount, SPLIT_BITS) * factor).cast("decimal(20,0)")
    low = F.sum(amount.bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)) * factor).cast("decimal(20,0)")
    whole = high * F.lit(1 << SPLIT_BITS).cast("decimal(7,0)") + low
    return (whole.cast(f"decimal({37 - places},0)") * _unit(places)).cast(f"decimal(28,{places})")


def quantity(places: Places = PLACES) -> Column:
    return as_decimal(units("l_quantity", places), places["l_quantity"])


def total_quantity(places: Places = PLACES) -> Column:
    """The exact sum of quantities, whose units fit a long."""
    return as_decimal(F.sum(units("l_quantity", places)), places["l_quantity"])


def receipt_day() -> Column:
    """The ship date stands in for the day of receipt."""
    return F.col("l_shipdate").cast("date")


def order_day() -> Column:
    return F.col("o_orderdate").cast("date")


def lead_days() -> Column:
    """Days from order to receipt; negative when the receipt predates its order."""
    return F.datediff(receipt_day(), order_day()).cast("bigint")


def count_if(condition: Column) -> Column:
    """How many rows meet the condition; a NULL condition does not count."""
    return F.count(F.when(condition, 1))


def share(part: str, whole: str) -> Column:
    """Part of a whole as a double, NULL when the whole is zero."""
    return F.try_divide(part, whole).cast("double")


def lookup(values: Mapping[str, int], key: str) -> Column:
    """A small mapping written into the plan as a literal; NULL for unknown keys."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(key))
