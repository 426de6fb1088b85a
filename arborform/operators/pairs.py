"""C11 pair features and E6 pair vectors (E7, the classifier on them, is in ``pair_model``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import FEATURE_COLS, check_lengths, mask_unknown, pad_all, wrapped_features


def text_hash(text: Column) -> Column:
    """Identity of a text; a null one is taken as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def pair_features(pairs: DataFrame, vocab: DataFrame, length: int = 512, key: str = "pair_id",
                  vocab_rows: int | None = None) -> DataFrame:
    """C11: both sides of each pair as feature rows (suffix _1, _2) + labels.

    pairs: (key, text_1, text_2, similar). See ``pair_features_of``.
    """
    both = F.explode(F.array(F.col("text_1"), F.col("text_2"))).alias("text")
    texts = pairs.select(both).select(text_hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    sides = pairs.select(key, text_hash(F.col("text_1")).alias("h_1"), text_hash(F.col("text_2")).alias("h_2"),
                         F.col("similar").cast("int").alias("labels"))
    return pair_features_of(sides, texts, vocab, length, key, vocab_rows)


def pair_features_of(sides: DataFrame, texts: DataFrame, vocab: DataFrame, length: int = 512,
                     key: str = "pair_id", vocab_rows: int | None = None) -> DataFrame:
    """C11 from hashed pairs: sides (key, h_1, h_2, labels), texts (h, text).

    No alignment (every leaf starts with tree mask 1), then tree mask 0 at
    unknown ids. Each different text is featurised once; the arrays travel
    unpadded through two joins by hash (one exchange of the features, used
    twice) and are padded in the last projection, which fails on a length other
    than L (C8). A null text is an empty one, so every pair has a row; a text
    shared by very many pairs is a skewed join key, which AQE splits.
    """
    f = wrapped_features(texts.select("h", "text").distinct(), vocab, "h", "text", length, align=False, vocab_rows=vocab_rows)
    f = f.withColumn("tree_attention_mask", mask_unknown(F.col("input_ids"), F.col("tree_attention_mask")))
    f = f.select("h", F.struct(*FEATURE_COLS).alias("f"))
    j = (sides.join(f.select(F.col("h").alias("h_1"), F.col("f").alias("f_1")), "h_1")
              .join(f.select(F.col("h").alias("h_2"), F.col("f").alias("f_2")), "h_2"))
    out = []
    for k in (1, 2):
        padded = pad_all({c: F.col(f"f_{k}.{c}") for c in FEATURE_COLS}, length)
        out += [padded[c].alias(f"{c}_{k}") for c in FEATURE_COLS]
    return check_lengths(j.select(key, *out, "labels"), length,
                         cols=[f"{c}_{k}" for k in (1, 2) for c in FEATURE_COLS], strict=True)


def adjacent_pairs(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Pairs (row k, row k+1) by key of rows (key, h, attr); labels = 1 when
    ``attr`` is equal. Only keys, hashes and the attribute meet."""
    a = df.select(F.col(key).alias("pair_id"), F.col("h").alias("h_1"), F.col(attr).alias("a1"))
    b = df.select((F.col(key) - 1).alias("pair_id"), F.col("h").alias("h_2"), F.col(attr).alias("a2"))
    return (a.join(b, "pair_id")
             .select("pair_id", "h_1", "h_2", F.col("a1").eqNullSafe(F.col("a2")).cast("int").alias("labels")))


def pair_vector(left: DataFrame, right: DataFrame, key: str = "pair_id",
                vec: str = "vec") -> DataFrame:
    """The first-position vector of each side, concatenated.

    left / right: (key, pos, vec, ...) token vectors of each side; other columns
    of first positions are carried along, so labels need no join of their own."""
    keep = lambda df, name: df.filter(F.col("pos") == 0).drop("pos").withColumnRenamed(vec, name)
    return (keep(left, "_v1").join(keep(right, "_v2"), key)
            .withColumn("pair_vec", F.concat("_v1", "_v2")).drop("_v1", "_v2"))
