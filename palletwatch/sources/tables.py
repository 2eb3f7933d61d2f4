"""Batch readers for the delivery tables in Parquet, CSV or JSON."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from palletwatch.sources.schemas import SCHEMAS

READ_OPTIONS = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}}


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table below ``path``, as ``name.fmt`` (a file or a folder of files).

    Parquet carries its own types, so filters and columns reach the scan; text
    formats get the declared schema, which saves the inference pass.
    """
    reader = spark.read.format(fmt).options(**READ_OPTIONS.get(fmt, {}))
    if fmt in READ_OPTIONS:
        reader = reader.schema(SCHEMAS[name])
    return reader.load(f"{path}/{name}.{fmt}")


@dataclass(frozen=True)
class Tables:
    """The delivery tables of one folder, each opened when first used."""

    spark: SparkSession
    path: str
    fmt: str = "parquet"

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name, self.fmt)

    @cached_property
    def region(self) -> DataFrame:
        return self._read("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self._read("nation")

    @cached_property
    def supplier(self) -> DataFrame:
        return self._read("supplier")

    @cached_property
    def part(self) -> DataFrame:
        return self._read("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self._read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self._read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self._read("events")
