"""Memory of Python workers.

Spark keeps a worker for later tasks, of any operator. What a task has freed stays with the worker's allocators, so the
workers of an executor add up to their highest tasks; give_back returns it to the system. What an operator remembers
for its next tasks goes when a task of another operator begins. A batch of rows stands in the executor's memory outside the heap
and again in the worker; lean_batches bounds it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Rows that a Python worker gets at a time.
BATCH_ROWS = 500

_REMEMBERED: list[Callable] = []


def remembered(cached: Callable) -> Callable:
    """cached, a function with a cache_clear, as one whose results last as long as its module's tasks follow each other."""
    _REMEMBERED.append(cached)
    return cached


def forget(module: str) -> None:
    """Drop what other modules than this one remember in this worker."""
    for cached in _REMEMBERED:
        if cached.__module__ != module:
            cached.cache_clear()


def lean_batches(spark: SparkSession) -> None:
    """From now on the session hands its Python workers BATCH_ROWS rows at a time at most; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def give_back() -> None:
    """Return freed memory to the system; allocators without such a call keep theirs."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function on a task's batches, with its memory given back after the last one; what other modules remember goes first."""

    def whole(batches):
        forget(run.__module__)
        yield from run(batches)
        give_back()

    return whole
