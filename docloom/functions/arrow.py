"""Python over Arrow data in small parts, so that a worker's memory doesn't grow with the batches that Spark sends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A part holds no more rows, and no more bytes unless it is a single row.
PART_ROWS, PART_BYTES = 256, 1 << 18
Part = TypeVar("Part", pa.Array, pa.RecordBatch)


def parts(whole: Part, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[Part]:
    """An array or a batch in order, halved until its parts are small. Nothing is copied."""
    waiting = [whole]
    while waiting:
        x = waiting.pop()
        n = len(x) if isinstance(x, pa.Array) else x.num_rows
        if n > 1 and (n > rows or x.nbytes > size):
            waiting += [x.slice(n // 2), x.slice(0, n // 2)]
        elif n:
            yield x


def each(c: Column, kind: str, one: Callable) -> Column:
    """``one`` of every value, nulls included, as a column of type ``kind``. A worker holds the Python values of one part."""
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in parts(batch):
                yield pa.array([one(x) for x in part.to_pylist()], arrow)

    return run(c)
