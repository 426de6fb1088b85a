"""Special-position mask and repeatable masked-token sampling.

Every random choice is a G3 draw of (seed, key, position): the same rows get
the same masks on any partitioning and on task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.draw import TWO_32
from .vocab import MASK_ID, SPECIAL_IDS

IGNORE = -100


def special_mask(ids: Column, specials=SPECIAL_IDS) -> Column:
    """1 where the id is a special id (start, pad, end, unknown, mask)."""
    return F.transform(ids, lambda x: x.isin(list(specials)).cast("int"))


def _per_position(ids: Column, key: Column, seed, fn) -> Column:
    """``fn(id, digest)`` per position, the digest one md5 of (seed, key, position);
    seed and key are made text once per row."""
    return bind(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), lambda start: F.transform(
        ids, lambda x, i: fn(x, F.md5(F.concat_ws(":", start, i.cast("string"))))))


def _below(p: float):
    """Whether a digest's first draw is below ``p``.

    The draw is the number of a digest's first 8 hex digits over 2^32, so the digest
    itself is compared, as text, with the hex digits of p * 2^32."""
    first_over = max(math.ceil(p * TWO_32), 0)
    return (lambda h: h < F.lit(f"{first_over:08x}")) if first_over < TWO_32 else (lambda h: h.isNotNull())


def _hits(ids: Column, key: Column, seed, specials, p: float) -> Column:
    """True at the chosen positions; special positions (padding included) and nulls are
    never chosen."""
    return _per_position(ids, key, seed, lambda x, h: ~x.isin(list(specials)) & _below(p)(h))


def _chosen(ids: Column, key: Column, seed, specials, p: float) -> Column:
    """The digests of the chosen positions, null elsewhere."""
    digests = _per_position(ids, key, seed, lambda x, h: F.when(~x.isin(list(specials)), h))
    return F.transform(digests, lambda h: F.when(_below(p)(h), h))


def _u(h: Column, slot: int) -> Column:
    return F.conv(F.substring(h, 1 + 8 * slot, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def mask_tokens(df: DataFrame, key: str, p: float, seed, ids_col: str = "input_ids",
                mask_id: int = MASK_ID, specials=SPECIAL_IDS) -> DataFrame:
    """D2 (evaluation masking): each non-special position is chosen with
    probability p; labels keep the original id at chosen positions and -100
    elsewhere (taken before the ids change); chosen ids become ``mask_id``."""
    staged = df.withColumn("_h", _hits(F.col(ids_col), F.col(key), seed, specials, p))
    return (staged.withColumn("labels", F.zip_with(ids_col, "_h", lambda x, h: F.when(h, x).otherwise(F.lit(IGNORE))))
                  .withColumn(ids_col, F.zip_with(ids_col, "_h", lambda x, h: F.when(h, F.lit(mask_id)).otherwise(x)))
                  .drop("_h"))


def mask_tokens_train(df: DataFrame, key: str, p: float, seed, vocab_size: int,
                      ids_col: str = "input_ids", mask_id: int = MASK_ID,
                      specials=SPECIAL_IDS, replace_rate: float = 0.8,
                      random_rate: float = 0.5) -> DataFrame:
    """D3 (training masking): chosen as in D2; of the chosen, ``replace_rate``
    become the mask id, then ``random_rate`` of the rest a random id in
    [0, vocab_size), the others stay. Four draws from one md5 per position."""
    staged = df.withColumn("_h", _chosen(F.col(ids_col), F.col(key), seed, specials, p))

    def new_id(x, h):
        rand_id = F.floor(_u(h, 3) * F.lit(vocab_size)).cast("int")
        return (F.when(h.isNull(), x)
                 .when(_u(h, 1) < F.lit(replace_rate), F.lit(mask_id))
                 .when(_u(h, 2) < F.lit(random_rate), rand_id)
                 .otherwise(x))

    return (staged.withColumn("labels", F.zip_with(ids_col, "_h", lambda x, h: F.when(
                h.isNotNull(), x).otherwise(F.lit(IGNORE))))
                  .withColumn(ids_col, F.zip_with(ids_col, "_h", new_id))
                  .drop("_h"))


def scored(df: DataFrame, key: str, ids_col: str = "input_ids",
           labels_col: str = "labels") -> DataFrame:
    """One row per scored position (label != -100)."""
    z = F.arrays_zip(F.col(ids_col).alias("id"), F.col(labels_col).alias("label"))
    return (df.select(key, F.posexplode(z).alias("pos", "z"))
              .filter(F.col("z.label") != F.lit(IGNORE))
              .select(key, F.col("pos").cast("int").alias("pos"),
                      F.col("z.id").alias("input_id"), F.col("z.label").alias("label")))
