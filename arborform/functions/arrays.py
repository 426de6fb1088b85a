"""Small column helpers on arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import ship_package_by_value


def pad(col: Column, length: int, value) -> Column:
    """Right-pad an array to ``length`` with ``value`` (longer arrays unchanged)."""
    n = F.greatest(F.lit(length) - F.size(col), F.lit(0))
    return F.concat(col, F.array_repeat(F.lit(value), n))


def int_text(col: Column, sep: str = ",") -> Column:
    """Integer array as text, for order-insensitive comparison with an oracle. Nulls
    are left out.

    Written as JSON in one pass over the numbers, without a string of each; only a
    row with a null in its array is joined from strings."""
    if sep != ",":
        return F.array_join(col.cast("array<string>"), sep)
    return bind(F.to_json(col), lambda j: F.when(j.contains("null"), F.array_join(col.cast("array<string>"), sep))
                .otherwise(F.substring(j, F.lit(2), F.length(j) - 2)))


def num_text(col: Column, scale: int = 6, sep: str = ",") -> Column:
    """Double array as text of integers x * 10^scale rounded (engine-neutral).

    ``rint`` is one machine operation; ``round`` goes through a decimal for every value."""
    m = float(10 ** scale)
    return F.array_join(F.transform(col, lambda x: F.rint(x * F.lit(m)).cast("bigint").cast("string")), sep)


def matrix(v: pa.Array) -> np.ndarray | None:
    """An Arrow array of lists as rows x values; None if a list or value is null,
    or the lists differ in length or are empty."""
    if v.null_count or not len(v):
        return None
    width = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    values = v.flatten()
    if values.null_count or not width[0] or (width != width[0]).any():
        return None
    return values.to_numpy(zero_copy_only=False).reshape(len(v), int(width[0]))


def list_array(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow array of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def numbers_md5(scale: int = 6, sep: str = ","):
    """``num_md5`` as a function of an Arrow array. Its ``texts`` are ``num_text`` of the
    rows of a matrix, joined by its ``sep``."""
    m = float(10 ** scale)

    def texts(rows: np.ndarray) -> pa.Array:
        # the cast fails on a value that is no 64-bit integer, as in num_text
        values = pa.array(np.rint(rows.reshape(-1) * m)).cast(pa.int64()).cast(pa.string())
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]))
        return pc.binary_join(pa.ListArray.from_arrays(ends, values), sep)

    def run(v: pa.Array) -> pa.Array:
        rows = matrix(v)
        if rows is not None:
            joined = texts(rows)
            at = np.frombuffer(joined.buffers()[1], np.int32)[:len(joined) + 1].tolist()
            data = memoryview(joined.buffers()[2])
            return pa.array([hashlib.md5(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
        each = [None if x is None else sep.join(str(_whole(y * m)) for y in x if y is not None) for x in v.to_pylist()]
        return pa.array([None if t is None else hashlib.md5(t.encode()).hexdigest() for t in each], pa.string())
    run.texts, run.sep = texts, sep
    return run


def num_md5(col: Column, scale: int = 6, sep: str = ",") -> Column:
    """md5 of ``num_text``, over the values of a whole Arrow batch at once."""
    ship_package_by_value()
    return F.arrow_udf(numbers_md5(scale, sep), "string")(col)


def _whole(x: float) -> int:
    out = int(np.rint(x))                   # fails on NaN and infinities
    if not -1 << 63 <= out < 1 << 63:
        raise OverflowError(f"no 64-bit integer: {x}")
    return out


def text_join(col: Column, sep: str = "\u001f") -> Column:
    """String array joined with a unit separator."""
    return F.array_join(col, sep)


def bind(col: Column, fn) -> Column:
    """Evaluate ``col`` once and hand it to ``fn`` as a lambda variable.

    The optimizer may inline a column's defining expression into a lambda
    that references it, re-evaluating it per element; a value passed in as a
    lambda argument is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(col), fn), 1)
