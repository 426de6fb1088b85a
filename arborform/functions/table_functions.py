"""G1 as a table function: user walks over the ordered rows of a group, from SQL.

``walk_function(walk, returns)`` makes a table function of a Python walk: the
walk gets the rows of one group, in order, one at a time, and gives any number of
output rows. Spark partitions and sorts:

    SELECT * FROM walk_leaves(TABLE(leaves) PARTITION BY doc_id ORDER BY leaf_pos)

A group is one task's work, row by row; the walk itself decides what it keeps. A
walk that has ``rows(batch)`` in place of ``row(row)`` gets the rows of its group as
Arrow record batches, in order, and gives Arrow tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from .batches import ship_package_by_value


def walk_function(walk: Callable[[], object], returns: str):
    """A table function from ``walk()``, an object with ``row(row)`` and ``end()``,
    both giving output rows (tuples in the order of ``returns``), or with
    ``rows(batch)`` and ``end()``, both giving Arrow tables of these columns."""
    ship_package_by_value()
    if hasattr(walk, "rows"):
        class Batches:
            def __init__(self):
                self.walk = walk()

            def eval(self, batch: pa.RecordBatch) -> Iterable[pa.Table]:
                yield from self.walk.rows(batch)

            def terminate(self) -> Iterable[pa.Table]:
                yield from self.walk.end()
        return arrow_udtf(Batches, returnType=returns)

    class Walk:
        def __init__(self):
            self.walk = walk()

        def eval(self, row: Row) -> Iterable[tuple]:
            yield from self.walk.row(row)

        def terminate(self) -> Iterable[tuple]:
            yield from self.walk.end()
    return udtf(Walk, returnType=returns)


def register_walk(spark: SparkSession, name: str, walk: Callable[[], object], returns: str) -> None:
    """Make the walk callable from SQL under ``name``."""
    spark.udtf.register(name, walk_function(walk, returns))


class LeafArrays:
    """B4 as a walk: the leaf rows of a document, in visit order, to one row of
    aligned arrays. The key is the first column."""

    def __init__(self):
        self.parts = []

    def rows(self, batch: pa.RecordBatch) -> Iterable[pa.Table]:
        self.parts.append(batch)
        return ()

    def end(self) -> Iterable[pa.Table]:
        if self.parts:
            leaves = pa.Table.from_batches(self.parts).combine_chunks()
            n, keys = len(leaves), leaves.column(0)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
            of = lambda name: one(leaves.column(name).chunk(0))
            ones = one(pa.array(np.ones(n, np.int32)))
            yield pa.table([keys.slice(n - 1), of("token"), ones, of("depth"), of("sib")], names=["doc_id", "tokens", "tree_mask", "depths", "sibs"])


LEAF_ARRAYS = "doc_id bigint, tokens array<string>, tree_mask array<int>, depths array<int>, sibs array<int>"
