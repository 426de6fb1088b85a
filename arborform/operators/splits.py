"""A8-A10 (seeded splits), F7 support (exact global ranks) and split labels.

No step puts all rows in one task: exact cuts come from small histograms
(at most 4,096 rows each, reduced to the driver) and exact ranks from a
range-partitioned sort with per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draw import draw, draw_int
from ..session import written


def assign_split(df: DataFrame, key: str, seed, bounds=(("train", 0.8),
                 ("validation", 0.9), ("test", 1.0)), col: str = "split") -> DataFrame:
    """Split label per row from a G3 draw u in [0, 1): the first split whose
    cumulative upper bound exceeds u. Map-only."""
    u = draw(seed, F.col(key))
    expr = None
    for name, upper in bounds[:-1]:
        expr = (F.when(u < F.lit(upper), F.lit(name)) if expr is None
                else expr.when(u < F.lit(upper), F.lit(name)))
    last = F.lit(bounds[-1][0])
    return df.withColumn(col, expr.otherwise(last) if expr is not None else last)


# Level widths of the histogram refinement over a 32-bit draw: 12 + 12 + 8 bits.
_LEVELS = ((20, 0xFFF), (8, 0xFFF), (0, 0xFF))


def kth_by_draw(df: DataFrame, d: Column, key: str, k: int):
    """(draw, key) of the row at 0-based rank k in (d, key) order.

    d is a 32-bit non-negative integer column. Three histogram passes narrow
    the rank to one draw value (each pass reads the key column only and
    reduces to at most 4,096 counts); the few rows sharing that value are
    ordered by key. Returns None if k is out of range.
    """
    base = df.select(F.col(key).alias("_k"), d.alias("_d"))
    prefix, shift_done = 0, 32
    cond = F.lit(True)
    for shift, mask in _LEVELS:
        width = shift_done - shift
        bucket = F.shiftright(F.col("_d"), shift).bitwiseAND(F.lit(mask))
        hist = sorted((r[0], r[1]) for r in base.filter(cond).groupBy(bucket.alias("b"))
                      .agg(F.count(F.lit(1)).alias("n")).collect())
        seen, chosen = 0, None
        for b, n in hist:
            if k < seen + n:
                chosen = b
                break
            seen += n
        if chosen is None:
            return None
        k -= seen
        prefix = (prefix << width) | chosen
        shift_done = shift
        cond = F.shiftright(F.col("_d"), shift) == F.lit(prefix)
    rows = base.filter(F.col("_d") == F.lit(prefix)).orderBy("_k").limit(k + 1).collect()
    return prefix, rows[-1][0]


def first_m_flag(df: DataFrame, d: Column, key: str, m: int) -> Column:
    """Column: True for the first m rows in (d, key) order (exact)."""
    if m <= 0:
        return F.lit(False)
    cut = kth_by_draw(df, d, key, m - 1)
    if cut is None:
        return F.lit(True)
    dk, kk = cut
    return (d < F.lit(dk)) | ((d == F.lit(dk)) & (F.col(key) <= F.lit(kk)))


def half_split(df: DataFrame, key: str, seed, col: str = "part",
               first: str = "valid", second: str = "test") -> DataFrame:
    """Exact random halves. In (draw, key) order the first floor(n/2)
    rows are ``first``, the rest ``second``."""
    d = draw_int(seed, "half", F.col(key))
    n = df.count()
    flag = first_m_flag(df, d, key, n // 2)
    return df.withColumn(col, F.when(flag, F.lit(first)).otherwise(F.lit(second)))


def first_n(df: DataFrame, key: str, seed, n: int) -> DataFrame:
    """The first n rows in shuffled order (top-k: n rows per partition)."""
    d = draw_int(seed, "half", F.col(key))
    return df.withColumn("_d", d).orderBy("_d", key).limit(n).drop("_d")


def assemble(parts: dict, col: str = "split") -> DataFrame:
    """A10: name the parts and stack them (union by column name)."""
    out = None
    for name, part in parts.items():
        p = part.withColumn(col, F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def global_rank(df: DataFrame, order, partitions: int | None = None) -> DataFrame:
    """0-based rank of every row in ``order`` (columns, ascending, unique).

    Range-partition on the order, sort inside partitions, number rows inside
    each partition, and add the row count of all earlier partitions. The
    range bounds come from sampling, so the laid-out rows are written once:
    counts and ranks then read the same layout. Hand over the key columns
    only and join the rest, if rows are wide.
    """
    order = [order] if isinstance(order, str) else list(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                      F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per partition: a bounded side, broadcast
    return (laid.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
                .withColumn("rank", (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
                .drop("_pid", "_mid", "_off", "_first"))


def group_rank(df: DataFrame, group: str, order: str, tie: str, out: str = "rank") -> DataFrame:
    """0-based rank of each row inside its group by (order, tie), exact, with
    no group ranked whole in one task: the rows are ranked over all groups in
    (group, order, tie) order, where a large group lies on many partitions, and
    the first rank of the group is taken off."""
    rows = global_rank(df, [group, order, tie])
    first = rows.groupBy(group).agg(F.min("rank").alias("_first"))
    return (rows.join(first, group).withColumn(out, F.col("rank") - F.col("_first"))
                .drop("_first", *([] if out == "rank" else ["rank"])))
