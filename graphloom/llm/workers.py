"""Python workers' memory: Arrow batches of bounded size, one operator's cache at a time,
and freed memory given back at the end of each task.

Spark keeps workers for later tasks, so what one operator leaves in them would otherwise
stand beside what the next one needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch (a longer single row is one batch), where the session has Spark's own value.
MOST, SPARKS = 4 << 20, "67108864b"

_held: dict[str, Any] = {}


def hold(name: str, make: Callable[[], Any]) -> Any:
    """This worker's `name`, made once; what another operator has left here goes."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    _held.clear()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns named by place, as clashing or dotted names can't be asked for, and those names."""
    place = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*place), place


def by_batch(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, caches: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) within bounds. caches: whether run calls hold().

    Where the session has Spark's own bound on an Arrow batch, MOST is set in its place and
    stays, as the result is lazy; a bound that the caller has set is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, SPARKS) == SPARKS:
        conf.set(BATCH, str(MOST))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not caches:
            forget()
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)
