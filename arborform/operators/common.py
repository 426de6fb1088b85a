"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side that a join sends to every executor.
BROADCAST_BYTES = 64 << 20


def broadcast_under(df: DataFrame, row_bytes: int, rows: int | None = None,
                    max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when ``rows`` rows of ``row_bytes`` bytes stay under the
    bound; else the frame is returned unhinted and the join shuffles. ``rows``
    is counted when it is not known from the construction."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= max_bytes else df
