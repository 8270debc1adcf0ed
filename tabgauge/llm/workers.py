"""Memory of Python workers, which Spark keeps for later tasks beside the executor's JVM."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that a task hands to Python at once: some MB of text rather than some tens.
BATCH_ROWS = 1000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def thrifty(function: Callable) -> Callable:
    """The function for mapInArrow; when a task ends, its worker gives back what it has freed."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


@contextmanager
def few_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is written inside hands Python at most so many rows at once, or fewer as set before."""
    before = spark.conf.get(_BATCH)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
