"""Batch writers: plain files, and receipts laid out by month.

Nothing is bucketed on an order or supplier key: a bucket is read by one task,
so a key holding a large part of the rows would end up there whole, out of
reach of the adaptive skew split that an ordinary shuffle join gets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwatch.functions.columns import receipt_day
from palletwatch.sources.schemas import LINEITEM

# Text formats cut timestamps to milliseconds unless told otherwise.
MICROSECONDS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
WRITE_OPTIONS = {"csv": {"header": "true", **MICROSECONDS}, "json": MICROSECONDS}


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A folder of files in Parquet, CSV or JSON."""
    df.write.format(fmt).options(**WRITE_OPTIONS.get(fmt, {})).mode(mode).save(path)


def write_by_month(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Receipt lines laid out by month of receipt; ``read_days`` reads back only the folders of a range of days.

    A filter on the date itself does not skip folders, only one on ``receipt_month`` does.
    ``rebalance`` gathers a month into few files and lets adaptive execution
    split a month that is too large for one task.
    """
    month = lines.withColumn("receipt_month", F.date_format(receipt_day(), "yyyy-MM"))
    month.hint("rebalance", "receipt_month").write.partitionBy("receipt_month").mode(mode).parquet(path)


def read_days(spark: SparkSession, path: str, first: dt.date, last: dt.date) -> DataFrame:
    """Receipt lines of a range of days, both ends included, from what ``write_by_month`` wrote."""
    months = F.col("receipt_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}")
    lines = spark.read.schema(f"{LINEITEM}, receipt_month string").parquet(path)
    return lines.filter(months & receipt_day().between(F.lit(first), F.lit(last))).drop("receipt_month")
