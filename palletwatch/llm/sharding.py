"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: a
starting slot and a step, both from its name. Shards take turns; at its turn a shard claims the
first slot of its order that is still free, until the table is full. A key then
goes to the shard of slot hash(key) mod size. Shards hold equal shares of slots, give or
take one, and when a shard joins or leaves, few keys move between the others.

The table has a fixed number of rows, given as a parameter and checked, so it is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 4099
LARGEST_TABLE = 1_000_003  # rows that are broadcast at most


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}{text}".encode()).hexdigest()[:8], 16)


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The place in ``shards`` of each slot's owner."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError("shards must have distinct names, and the table a prime size no less than their number")
    at = [_hash(shard, "offset:") % size for shard in shards]
    step = [_hash(shard, "skip:") % (size - 1) + 1 for shard in shards]
    owner = [-1] * size
    left = size
    while True:
        for shard, skip in enumerate(step):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot`` and ``shard``, one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo the table size; a null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(size)


def sharded(df: DataFrame, key: Column, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, by one broadcast lookup and no shuffle.

    Rows of equal keys share a shard; a null key is placed like an empty text. Columns of ``df`` that are
    called slot or shard give way to the new ones.
    """
    table = lookup_table(df.sparkSession, shards, size)
    placed = df.withColumn("_slot", slot_of(key, size)).drop("slot", "shard").withColumnRenamed("_slot", "slot")
    return placed.join(F.broadcast(table), "slot").select(*(c for c in placed.columns if c != "slot"), "slot", "shard")
