"""Documents in chunks of bounded size, by document id, so that a chunk can be met twice.

A chunk first sends what it holds to buckets that see all chunks, each distinct
item once; the answers come back to the chunk, which works out the rest for its
own rows. A key that very many rows share so reaches its bucket once per chunk,
and the second use of the chunks reads the same shuffle files as the first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one number reaches the driver."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def in_chunks(docs: DataFrame, total: int, chunk_bytes: int = CHUNK_BYTES, spread: bool = False) -> DataFrame:
    """``docs`` with a column ``_chunk`` in front; rows of one id share a chunk, with ``spread`` only those of one text, too."""
    n = max(1, math.ceil(total / chunk_bytes))
    names = [F.col("doc_id").cast("bigint"), *([F.xxhash64("text")] if spread else [])]
    place = F.pmod(F.xxhash64(*names), F.lit(n))
    return docs.select(place.alias("_chunk"), "*")
