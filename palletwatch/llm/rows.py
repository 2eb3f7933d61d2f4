"""Columns worked out from whole texts in tasks, a bounded slice of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from palletwatch.llm.blocks import pieces

SLICE_BYTES = 2 << 20


def with_columns(
    docs: DataFrame,
    added: str,
    work: Callable[[], Callable[[Sequence[bytes | None]], Sequence[Sequence]]],
    text: str = "text",
    drop: Sequence[str] = (),
) -> DataFrame:
    """``docs`` with the columns of the DDL string ``added``, row by row from one text column.

    ``work()`` is called once in each task, for what a task needs to set up; what it
    returns gets the texts of a slice in UTF-8 (None for null) and gives the added
    columns. A column of ``docs`` that has the name of an added one gives way to
    it. No shuffle; rows and their order stay.
    """
    new = T.StructType.fromDDL(added)
    docs = docs.drop(*(name for name in new.names if name != text))
    stay = [name for name in docs.columns if name not in drop and name not in new.names]
    schema = T.StructType([docs.schema[name] for name in stay] + new.fields)
    kinds = [to_arrow_type(field.dataType) for field in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = work()
        for batch in batches:
            for lo, hi, texts in pieces(batch[text], SLICE_BYTES):
                made = [
                    column if isinstance(column, pa.Array) else pa.array(column, kind)
                    for column, kind in zip(columns(texts), kinds, strict=True)
                ]
                kept = [batch[name].slice(lo, hi - lo) for name in stay]
                yield pa.RecordBatch.from_arrays(kept + made, stay + new.names)
        pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks

    return docs.mapInArrow(run, schema)
