"""Operator 10: mixing sources to target weights by a splitting tree.

Targets. Source weights share ``budget`` times all sizes; a source is capped at
``cap`` times its own size and the excess is reshared by weight until no source
is above its cap (solved in closed form from the sorted cap / weight ratios).

Blocks. A source's documents are dealt to 256 blocks by a hash of the key. The mix
takes each block floor(target / size) times, and blocks that meet the rest of the
target once more; which ones, the tree decides.

Splitting tree. All blocks of a source, one slot for each copy that may be taken,
are its exact block quota. From the root down, the quotas of all sources at a node
are split between its two children as a random permutation of the node's slots is
cut: the counts per source are then a multivariate hypergeometric draw, and at the
leaves each output shard has an exact quota of slots of each source. Each shard
then draws its quota from the source's permuted blocks, in disjoint runs.

Selection. The rest of a source's target is filled from the draws of all shards in
turn: every shard's first drawn block, every shard's second, and so on. The block
in which the target is reached is summed row by row, in hash order, and one more
document, of those not reached, is taken that comes nearest to what is missing.
Rows are shuffled locally by a hash key within their shard.

Only key, source and size are ranked; the wide rows meet a small block table.

Defined results: null text has size 0 and null source sorts last; a source of
size 0 has target 0 and none of its rows is taken; repeated keys share one
place in the order and are taken alike; an empty table gives no rows; columns
that clash with helper names are carried in a struct and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_under, hash60, scratch

SEED = 4099
WEIGHTS = (3.0, 1.0, 2.0)       # fixed values: weights of the sources, repeating
BUDGET = 1.5                    # fixed value: share of all sizes that the mix takes
CAP = 2.0                       # fixed value: times that a source may be repeated
BLOCK_BITS = 8                  # blocks per source: 2^8
SHARDS = 16
BLOCK_ROWS = 200_000            # largest block table that is broadcast


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target (double).

    One row per source: the windows run over the source list only. The level
    L solves sum(min(cap * size, L * weight)) = budget * total: sources sorted
    by cap / weight are full up to a point, the others get L * weight.
    """
    n = len(weights)
    i = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(n))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), i.cast("int") + 1)
    t = (sizes.withColumn("w", w)
         .withColumn("lim", F.col("source_size") * F.lit(float(cap)))
         .withColumn("ratio", F.col("lim") / F.col("w")))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    t = (t.withColumn("full", F.coalesce(F.sum("lim").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("all", F.sum("source_size").over(Window.partitionBy())))
    t = t.withColumn("level", (F.col("all") * F.lit(float(budget)) - F.col("full")) / F.col("open_w"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    # with the whole cap used up no source stays open, and all get their cap
    return t.withColumn("level", level).select(
        "source", "source_size", F.least("lim", F.coalesce(F.col("level") * F.col("w"), F.col("lim"))).alias("target"))


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, weights=WEIGHTS,
         budget=BUDGET, cap=CAP) -> tuple[DataFrame, DataFrame]:
    """rows(key, source, size, h) -> (sources, blocks).

    sources: source, source_size, target, base, cut (hash up to which documents of
    the block in which the target is reached are taken once more; -1: none), extra
    (hash of one more; -1: none). blocks: source, block, homes (array with the
    output shard of each copy), part (2: taken once more, 1: up to the cut, 0: not).
    """
    spread = (rows.groupBy("source", block_of("h").alias("block"))
              .agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("block_rows")))
    spread = scratch(spread, "mix-blocks")              # sources x 256 rows
    sizes = spread.groupBy("source").agg(F.sum("block_size").alias("source_size"))
    t = targets(sizes, weights, budget, cap)
    size = F.greatest(F.col("source_size"), F.lit(1))
    t = (t.withColumn("base", F.floor(F.col("target") / size).cast("int"))
         .withColumn("left", F.col("target") - F.col("base") * F.col("source_size")))
    t = scratch(t, "mix-targets")
    slots = homes(spread, t, shards, seed)
    # blocks in the order of the shards' draws, with the size before them
    last = (slots.join(F.broadcast(t.select(F.col("source").alias("s2"), "base", "left")), F.col("source").eqNullSafe(F.col("s2")))
            .filter(F.col("copy") == F.col("base") + 1).drop("s2", "base", "copy"))
    order = Window.partitionBy("source").orderBy("place", "shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    b = (last.join(spread.select(F.col("source").alias("s3"), F.col("block").alias("b3"), "block_size"),
                   (F.col("block") == F.col("b3")) & F.col("source").eqNullSafe(F.col("s3")))
         .withColumn("ahead", F.coalesce(F.sum("block_size").over(order), F.lit(0))))
    part = F.when(F.col("ahead") + F.col("block_size") < F.col("left"), 2).when(F.col("ahead") < F.col("left"), 1).otherwise(0)
    b = scratch(b.select("source", "block", "ahead", "left", part.alias("part")), "mix-parts")
    # the block that the rest of the target falls into, summed row by row (equal hashes together)
    mid = b.filter("part = 1").select(F.col("source").alias("s3"), F.col("block").alias("b3"), "ahead", "left")
    inner = (rows.withColumn("block", block_of("h"))
             .join(F.broadcast(mid), (F.col("block") == F.col("b3")) & F.col("source").eqNullSafe(F.col("s3")))
             .groupBy("source", "ahead", "left", "h").agg(F.sum("size").alias("size")))
    run = F.col("ahead") + F.sum("size").over(Window.partitionBy("source").orderBy("h"))
    inner = inner.withColumn("run", run)
    cut = (inner.filter(F.col("run") <= F.col("left")).groupBy("source")
           .agg(F.max("h").alias("hc"), F.max("run").alias("rc")).select(F.col("source").alias("s4"), "hc", "rc"))
    sources = (t.join(F.broadcast(mid.select("s3", "ahead")), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3")
               .join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("s4")), "left").drop("s4")
               .select("source", "source_size", "target", "base", F.coalesce("hc", F.lit(-1)).alias("cut"),
                       (F.col("left") - F.coalesce("rc", "ahead", F.lit(0))).alias("gap")))
    sources = scratch(sources, "mix-cuts")
    blocks = (slots.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("homes"))       # two copies at most
              .join(b.select(F.col("source").alias("s3"), F.col("block").alias("b3"), "part"),
                    (F.col("block") == F.col("b3")) & F.col("source").eqNullSafe(F.col("s3")), "left")
              .select("source", "block", "homes", F.coalesce("part", F.lit(0)).alias("part")))
    blocks = scratch(blocks, "mix-homes")
    # one document not reached whose size comes nearest to what is still missing
    g = sources.filter("gap > 0").select(F.col("source").alias("s2"), "cut", "gap")
    off = F.abs(F.col("gap") - F.col("size"))
    reached = (F.col("part") == 2) | ((F.col("part") == 1) & (F.col("h") <= F.col("cut")))
    open_rows = (with_block(rows, blocks).join(F.broadcast(g), F.col("source").eqNullSafe(F.col("s2"))).filter(~reached))
    more = (open_rows.groupBy("source", "gap", "h").agg(F.sum("size").alias("size"))
            .filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "h")).alias("m"))
            .select(F.col("source").alias("s4"), F.col("m.h").alias("extra")))
    sources = scratch(sources.join(F.broadcast(more), F.col("source").eqNullSafe(F.col("s4")), "left")
                      .select("source", "source_size", "target", "base", "cut",
                              F.coalesce("extra", F.lit(-1)).alias("extra")), "mix-sources")
    return sources, blocks


def block_of(h: str):
    return F.shiftright(h, 60 - BLOCK_BITS).cast("int")


def with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows(source, h, ...) with ``homes`` and ``part`` of their block."""
    b = blocks.select(F.col("source").alias("s3"), F.col("block").alias("b3"), "homes", "part")
    side = broadcast_under(b, blocks.count(), BLOCK_ROWS)
    return rows.join(side, F.col("source").eqNullSafe(F.col("s3")) & (block_of("h") == F.col("b3")), "left").drop("s3", "b3")


def homes(spread: DataFrame, targets_: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, copy, shard, place): splitting tree over block slots, then
    disjoint permuted runs per shard; ``place`` counts a shard's draws of a source."""
    s2 = targets_.select(F.col("source").alias("s2"), (F.col("base") + F.when(F.col("left") > 0, 1).otherwise(0)).alias("copies"))
    slots = (spread.join(F.broadcast(s2), F.col("source").eqNullSafe(F.col("s2"))).filter("copies > 0")
             .select("source", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
                     F.lit(0).alias("lo"), F.lit(shards).alias("hi")))
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        node = Window.partitionBy("lo", "hi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        # the left child's capacity: its part of the node's blocks
        r = F.row_number().over(node.orderBy(hash60(f"{seed}-{level}", "lo", "source", "block", "copy"), F.col("source"), "block", "copy"))
        slots = (slots.withColumn("mid", mid).withColumn("r", r).withColumn("n", F.count(F.lit(1)).over(node))
                 .withColumn("left", (F.col("hi") - F.col("lo") > 1)
                             & (F.col("r") * (F.col("hi") - F.col("lo")) <= F.col("n") * (F.col("mid") - F.col("lo"))))
                 .withColumn("wide", F.col("hi") - F.col("lo") > 1)
                 .select("source", "block", "copy",
                         F.when(F.col("wide") & ~F.col("left"), F.col("mid")).otherwise(F.col("lo")).alias("lo"),
                         F.when(F.col("wide") & F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi")))
    quota = slots.groupBy("source", F.col("lo").alias("shard")).agg(F.count(F.lit(1)).alias("q"))
    run = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = quota.withColumn("first", F.coalesce(F.sum("q").over(run), F.lit(0)))
    runs = runs.select(F.col("source").alias("s5"), "shard", "first",
                       F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("q"))).alias("p5"))
    drawn = Window.partitionBy("source").orderBy(hash60(f"{seed}-draw", "source", "block", "copy"), "block", "copy")
    at = slots.select("source", "block", "copy").withColumn("p", F.row_number().over(drawn))
    out = at.join(runs, (F.col("p") == F.col("p5")) & F.col("source").eqNullSafe(F.col("s5")))
    return scratch(out.select("source", "block", "copy", "shard", (F.col("p") - F.col("first")).cast("int").alias("place")), "mix-slots")


def keyed(df: DataFrame, key: str, source: str, size, seed: int = SEED) -> DataFrame:
    """Narrow rows (key, source, size, h) of ``df``."""
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"),
                     hash60(seed, key).alias("h"))


def place(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows(source, h, ...) with source_size, target and ``copies``: the shard of
    each copy that the mix takes (empty: the row is not taken)."""
    s = sources.select(F.col("source").alias("s2"), "source_size", "target", "base", "cut", "extra")
    rows = with_block(rows, blocks).join(broadcast_under(s, blocks.count(), BLOCK_ROWS), F.col("source").eqNullSafe(F.col("s2")), "left")
    more = (F.col("part") == 2) | ((F.col("part") == 1) & (F.col("h") <= F.col("cut"))) | (F.col("h") == F.col("extra"))
    take = F.col("base") + F.when(more, 1).otherwise(0)
    copies = F.when(take > 0, F.transform(F.slice("homes", F.lit(1), take), lambda x: x["shard"])).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("copies", copies).drop("s2", "homes", "part", "base", "cut", "extra")


def mix(df: DataFrame, key: str, source: str, size, shards: int = SHARDS, seed: int = SEED,
        weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """The mixed rows: the columns of ``df``, once per copy taken, plus ``_shard``
    and ``_key`` (order within the shard). Wide rows are not shuffled."""
    rows = scratch(keyed(df, key, source, size, seed), "mix-rows")
    sources, blocks = plan(rows, shards, seed, weights, budget, cap)
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     F.col(source).alias("source"), hash60(seed, key).alias("h"))
    out = place(wide, sources, blocks).select("_row", "h", F.posexplode("copies").alias("_copy", "_shard"))
    return out.select("_row.*", "_shard", hash60(f"{seed}-order", "h", "_shard", "_copy").alias("_key"))
