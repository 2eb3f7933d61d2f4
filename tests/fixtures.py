"""Small tables for cases the driver tables do not contain."""

from __future__ import annotations

import datetime as dt

from palletwatch.sources import schemas


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def line(order=1, part=1, supplier=1, number=1, quantity=1.0, price=10.0, discount=0.0, tax=0.0,
         returned="N", received="2000-01-10"):
    return (order, part, supplier, number, quantity, price, discount, tax, returned, "O", day(received))


def order(key=1, total=10.0, ordered="2000-01-01", priority="1-URGENT"):
    return (key, 1, "O", total, day(ordered), priority)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LINEITEM)


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ORDERS)


def parts(spark, *keys):
    return spark.createDataFrame([(k, "p", "b", "t", 1, 1.0) for k in keys], schemas.PART)


def suppliers(spark, *keys):
    return spark.createDataFrame([(k, f"s{k}", 1, 0.0) for k in keys], schemas.SUPPLIER)


def events(spark, *rows):
    """Rows of (event_id, minutes after the start of 2024, dock)."""
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, start + dt.timedelta(minutes=m), dock, "view", 1.0, "{}") for i, m, dock in rows], schemas.EVENTS
    )


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())
