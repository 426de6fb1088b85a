"""Repeatable uniform draws.

A draw is a pure function of (seed, columns): the md5 of the values joined
with ':' read as 32-bit integers. It does not depend on partitioning, task
retries or row order, unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def _digest(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [_as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def draw_int(seed, *cols, slot: int = 0) -> Column:
    """Integer in [0, 2^32) from hex digits 8*slot+1 .. 8*slot+8 of the md5."""
    return F.conv(F.substring(_digest(seed, cols), 1 + 8 * slot, 8), 16, 10).cast("bigint")


def draw(seed, *cols, slot: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(seed, *cols, slot=slot) / F.lit(TWO_32)


def draw_slots(seed, *cols, n: int = 4) -> list[Column]:
    """Up to four independent uniforms from one md5 (one hash per row)."""
    if not 1 <= n <= 4:
        raise ValueError("one md5 has four 32-bit slots")
    dig = _digest(seed, cols)
    return [F.conv(F.substring(dig, 1 + 8 * k, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
            for k in range(n)]
