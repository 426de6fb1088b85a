"""G1: a user function over column batches, run in parallel by Spark."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame


def ship_package_by_value() -> None:
    """Pickle this package's functions by value, so Python workers can run
    them without the package being importable on the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def hand_back() -> None:
    """Freed memory goes back to the system, so a worker that waits holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc
    if trim:
        trim(0)


def frugal(run):
    """``run`` over Arrow batches, handing memory back after each batch that it gives."""
    def task(batches):
        given = run(batches)
        while (batch := next(given, None)) is not None:
            yield batch
            del batch
            hand_back()
    return task


def map_batches(df: DataFrame, fn, schema, **kwargs) -> DataFrame:
    """Apply ``fn(batch: pandas.DataFrame, **kwargs) -> pandas.DataFrame`` to
    every Arrow batch of every partition. The output schema must be declared
    (it is not inferred from the first batch)."""
    ship_package_by_value()

    def run(batches):
        for b in batches:
            yield fn(b, **kwargs)
    return df.mapInPandas(run, schema)
