"""Operator 7: sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r of a
source of n rows gets the fraction (2r + 1) / 2n. Sorted by that fraction the
sources are interleaved in proportion, and equal cuts of the sequence give
shards that each hold the corpus's mixture, with counts at most one apart.

No source is ranked in one task: a source is cut into hash buckets of a few
thousand rows, buckets are ranked on their own, and the row counts of the
earlier buckets are added. The global order is cut the same way by fraction.

Defined results: a null source is a source of its own; a null key is the key
``null``; equal keys are ordered by the tie columns, and rows equal in all of
them are interchangeable; an empty table gives no rows. Columns named like
the helper columns (``_h``, ``_b`` ...) are not touched: the operator works on a
narrow projection under private names and returns only what it was asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_for, broadcast_under, hash60

SEED = 7123
CUT_ROWS = 200_000          # largest table of cut points that is broadcast


def ranked(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (key, source, tie, ...) with h, shard (int) and slot (long)."""
    n = rows.count()
    bits = bits_for(n)
    rows = rows.withColumn("h", hash60(seed, "key"))
    # the top bits of the hash cut a source, however large, into even buckets
    rows = rows.withColumn("b", F.shiftright("h", 60 - bits))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (rows.groupBy("source", "b").agg(F.count(F.lit(1)).alias("bn"))
             .withColumn("off", F.coalesce(F.sum("bn").over(before), F.lit(0)))
             .withColumn("n", F.sum("bn").over(Window.partitionBy("source")))
             .select(F.col("source").alias("s2"), F.col("b").alias("b2"), "off", "n"))
    in_bucket = Window.partitionBy("source", "b").orderBy("h", "key", "tie")
    one = (rows.withColumn("r", F.row_number().over(in_bucket) - 1)
           .join(sizes, (F.col("b") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s2")))
           .withColumn("f", (2 * (F.col("off") + F.col("r")) + 1) / (2 * F.col("n")))
           .drop("s2", "b2", "off", "n", "b", "r"))
    one = one.withColumn("g", F.floor(F.col("f") * (1 << bits)).cast("bigint"))
    counts = one.groupBy("g").agg(F.count(F.lit(1)).alias("gn"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)   # 2^bits rows
    starts = counts.select(F.col("g").alias("g2"), F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("first"))
    in_cut = Window.partitionBy("g").orderBy("f", F.col("source").asc_nulls_last(), "h", "key", "tie")
    two = (one.withColumn("r", F.row_number().over(in_cut) - 1)
           .join(starts, F.col("g") == F.col("g2"))
           .withColumn("at", F.col("first") + F.col("r")))
    total, k = F.lit(n).cast("bigint"), F.lit(shards).cast("bigint")
    shard = F.floor(F.col("at") * k / total).cast("bigint") if n >= 1 << 40 else F.expr(f"(at * {shards}L) div {max(n, 1)}L")
    return (two.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("at") - F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L"))
            .drop("g", "g2", "first", "r", "at", "f"))


def interleave(df: DataFrame, key: str, source: str, shards: int, seed: int = SEED,
               tie: Column | None = None, carry=()) -> DataFrame:
    """Narrow assignment: one row per input row with key, ``carry``, shard, slot."""
    tie = F.lit(0) if tie is None else tie
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), tie.alias("tie"),
                     *[F.col(c).alias(f"c_{c}") for c in carry])
    out = ranked(rows, shards, seed)
    return out.select(F.col("key").alias(key), *[F.col(f"c_{c}").alias(c) for c in carry], "shard", "slot")


def add_shards(df: DataFrame, key: str, source: str, shards: int, tie_text: str,
               seed: int = SEED, out: str = "shard") -> DataFrame:
    """All columns of ``df`` plus the shard (in place of a column of that name),
    without shuffling the wide rows.

    Within a source the shards are consecutive ranges of the seeded order, so
    the narrow ranking is reduced to the last (hash, key, tie) of each source
    and shard, and each wide row finds its shard by comparing with those cut
    points. Only groups of rows equal in key and text that a cut runs through
    are numbered one by one.
    """
    tie = F.xxhash64(F.coalesce(F.col(tie_text), F.lit("")))
    narrow = df.select(F.col(key).alias("key"), F.col(source).alias("source"), tie.alias("tie"))
    at = ranked(narrow, shards, seed).withColumn("t", F.struct("h", F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("k"), "tie"))
    # rows of one tuple are consecutive in the order: the few that straddle a cut
    ends = (at.groupBy("source", "shard").agg(F.max("t").alias("hi"), F.min("t").alias("lo")))
    edge = ends.select("source", F.explode(F.array("hi", "lo")).alias("t")).distinct()
    split = (at.join(edge, at["source"].eqNullSafe(edge["source"]) & (at["t"] == edge["t"]), "left_semi")
             .groupBy("source", "t", "shard").agg(F.count(F.lit(1)).alias("m")))
    split = (split.groupBy("source", "t").agg(F.sort_array(F.collect_list(F.struct("shard", "m"))).alias("parts"))
             .filter(F.size("parts") > 1))               # at most `shards` parts each
    cuts = ends.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "hi"))).alias("cuts"))
    known = cuts.join(
        split.groupBy(F.col("source").alias("s3")).agg(F.collect_list(F.struct("t", "parts")).alias("split")),
        F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
    known = known.select(F.struct("source", "cuts", "split").alias("_known"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("_row"),
                     F.struct(hash60(seed, key).alias("h"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), tie.alias("tie")).alias("_t"))
    rows = rows.join(broadcast_under(known, known.count(), CUT_ROWS // shards),
                     F.col(f"_row.{source}").eqNullSafe(F.col("_known.source")))
    rows = rows.withColumn("_parts", F.expr("get(filter(_known.split, x -> x.t = _t), 0).parts"))
    whole = rows.filter("_parts is null").select(
        "_row.*", F.expr("get(filter(_known.cuts, x -> x.hi >= _t), 0).shard").alias(out))
    j = F.row_number().over(Window.partitionBy(F.col("_known.source"), F.col("_t")).orderBy(F.lit(1)))
    apart = (rows.filter("_parts is not null").withColumn("_j", j)
             .select("_row.*", F.expr("""aggregate(_parts, struct(cast(0 as bigint) as seen, cast(null as int) as s),
                (a, p) -> struct(a.seen + p.m as seen, if(a.s is null and _j <= a.seen + p.m, p.shard, a.s) as s)).s""").alias(out)))
    return whole.unionByName(apart)
