"""Batches of bounded size between executors and their Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, of which an executor's Python worker holds several copies. A session that has more is set to this by
#: mapped(); it only bounds memory.
BATCH, CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    most = conf.get(CONF).lower().rstrip("b")
    if not most.isdigit() or not 0 < int(most) <= BATCH:
        conf.set(CONF, str(BATCH))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches; what a task's Python worker no longer needs is given back when it ends, as it
    serves many tasks."""
    small_batches(df)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(whole, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, none empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
