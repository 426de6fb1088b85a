"""Shuffled batches by epoch without a sort: a keyed permutation of row ranks.

Every epoch reads the rows in another random order. Sorting by a draw would move
all rows once for each epoch. Here a row has a rank (``splits.global_rank``, once)
and an epoch is a pseudo-random permutation of the ranks: a Feistel network, which
is a bijection of the numbers of a fixed width whatever its round function. The
width is the smallest that holds all ranks; a result beyond the last rank goes
through the network again until it is one (cycle walking), which keeps the
bijection. The place of a row in any epoch, and the rank that stands at any
place, are therefore column expressions: a batch of any epoch can be read by its
ranks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draw import draw_int
from .splits import global_rank

ROUNDS = 6              # even, so both halves get their width back
WALKS = 64              # a walk goes on with a chance under 1/2 each time


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and right half for ranks 0 to n - 1."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _rounds(x: Column, n: int, seed, epoch: Column, back: bool) -> Column:
    """x through the network, or back through it."""
    left, right = widths(n)
    low = lambda bits: F.lit((1 << bits) - 1).cast("bigint")

    def one(s, i):
        # the half that the round changes has the left width in even rounds
        kept, other = (s["l"], s["r"]) if back else (s["r"], s["l"])
        f = draw_int(seed, F.lit("epoch"), epoch, i, kept).bitwiseAND(F.when(i % 2 == 0, low(left)).otherwise(low(right)))
        changed = other.bitwiseXOR(f)
        return F.struct(changed.alias("l"), kept.alias("r")) if back else F.struct(kept.alias("l"), changed.alias("r"))
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(low(right)).alias("r"))
    return F.aggregate(order, start, one, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def _walk(x: Column, n: int, seed, epoch: Column, back: bool) -> Column:
    first = _rounds(x.cast("bigint"), n, seed, epoch, back)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(_rounds(v, n, seed, epoch, back)))
    # one in 2^64 ranks, if at all
    return F.when(last < n, last).when(last.isNotNull(), F.raise_error(F.lit("a rank walked out of the permutation")).cast("bigint"))


def place_of(rank: Column, n: int, seed, epoch: Column) -> Column:
    """Place in the epoch, 0 to n - 1, of the row with this rank (null for null)."""
    return _walk(rank, n, seed, epoch, back=False)


def rank_at(place: Column, n: int, seed, epoch: Column) -> Column:
    """Rank of the row that stands at this place of the epoch (null for null)."""
    return _walk(place, n, seed, epoch, back=True)


def epoch_batches(df: DataFrame, order, seed, epochs: int, size: int) -> DataFrame:
    """(order..., epoch, place, batch): every row's place and batch of ``size``
    rows in epochs 0 to ``epochs`` - 1, the last batch short. Only the order
    columns are ranked; nothing is sorted by epoch."""
    order = [order] if isinstance(order, str) else list(order)
    ranked = global_rank(df.select(*order), order)
    n = df.count()
    each = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    each = each.withColumn("place", place_of(F.col("rank"), max(1, n), seed, F.col("epoch")))
    return each.select(*order, "epoch", "place", F.floor(F.col("place") / size).cast("bigint").alias("batch"))


def batch_ranks(spark: SparkSession, n: int, seed, epoch: int, batch: int, size: int) -> DataFrame:
    """(place, rank) of one batch of an epoch, without looking at any row."""
    places = spark.range(min(n, batch * size), min(n, (batch + 1) * size)).select(F.col("id").alias("place"))
    return places.withColumn("rank", rank_at(F.col("place"), max(1, n), seed, F.lit(epoch)))
