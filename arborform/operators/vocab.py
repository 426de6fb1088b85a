"""C4 vocabulary table and C3 token -> id lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import BROADCAST_BYTES, broadcast_under
from .heavy import frequent
from .trees import BLANK_CHARS

# Special tokens and their ids (start, pad, end, unknown, mask).
SPECIALS = [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("<mask>", 4)]
START_ID, PAD_ID, END_ID, UNK_ID, MASK_ID = 0, 1, 2, 3, 4
SPECIAL_IDS = [0, 1, 2, 3, 4]
FIRST_WORD_ID = 5
# Bytes that a vocabulary row takes on an executor, about.
VOCAB_ROW_BYTES = 64


def _entering(rows: DataFrame) -> DataFrame:
    """The rows whose ``token`` can enter a vocabulary."""
    return (rows.filter(F.trim(F.col("token"), F.lit(BLANK_CHARS)) != F.lit(""))
                .filter(~F.col("token").isin([t for t, _ in SPECIALS])))


def _words(tokens: DataFrame, col: str) -> DataFrame:
    return _entering(tokens.select(F.col(col).alias("token")))


def _ranked(counts: DataFrame, size: int) -> DataFrame:
    """Specials and the ``size`` first of (token, n) by count descending, token ascending."""
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    ranked = top.select("token", (F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc("token"))) + F.lit(FIRST_WORD_ID - 1))
        .cast("int").alias("id"))
    return counts.sparkSession.createDataFrame(SPECIALS, "token string, id int").unionByName(ranked)


def build_vocab_frequent(tokens: DataFrame, size: int, col: str = "token", counters: int | None = None) -> DataFrame:
    """C4 by summaries (``heavy.frequent``): the same rows as ``build_vocab``, for
    corpora whose different tokens are too many to shuffle. Reads the tokens twice."""
    words = _words(tokens, col)
    counts = frequent(words, size, counters=counters)
    return build_vocab(tokens, size, col) if counts is None else _ranked(counts, size)


def build_vocab(tokens: DataFrame, size: int, col: str = "token", times: str | None = None) -> DataFrame:
    """C4: (token, id). Specials take 0-4; then the ``size`` most frequent
    non-blank tokens, by count descending then token ascending, take 5, 6, ...

    A top-k's final merge (partitions x size rows in one task) would grow with
    the cluster, so the distinct-token counts are first cut at the exact count
    of the size-th token (``_keep_top_counts``).

    groupBy-count combines map-side, so a very frequent token costs one row
    per partition before the shuffle. Only the ``size`` rows of the result are
    ranked in a single task. ``times`` names a column that says how many tokens a
    row stands for (``trees.layout_token_counts``); without it, a row is one.
    """
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = tokens.groupBy(F.col(col).alias("token")).agg(n.alias("n"))
    return _ranked(_keep_top_counts(counts, size), size)


def _keep_top_counts(counts: DataFrame, size: int) -> DataFrame:
    """Keep only tokens whose count can be among the ``size`` largest.

    The distinct-token counts are written once to the shared folder and those of
    tokens that cannot enter left out; a
    histogram of distinct count values (largest first, at most ``size``
    rows, and never more rows than there are distinct counts) gives the
    exact count t of the size-th token, and tokens below t are dropped.
    """
    # what can enter is decided on the written counts, so per different token: a
    # filter before would be pushed below the count, to every occurrence
    counts = _entering(written(counts, "token-counts"))
    hist = (counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
                  .orderBy(F.desc("n")).limit(size).collect())
    seen = 0
    for n, k in hist:
        seen += k
        if seen >= size:
            return counts.filter(F.col("n") >= F.lit(n))
    return counts


def vocab_side(vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """The vocabulary as a join side: broadcast under a bound in bytes, its rows
    known from ``bound`` (size + 5 from ``build_vocab``) or counted."""
    return broadcast_under(vocab, VOCAB_ROW_BYTES, bound)


def vocab_fits(rows: int) -> bool:
    """Whether ``vocab_side`` broadcasts a vocabulary of that many rows."""
    return rows * VOCAB_ROW_BYTES <= BROADCAST_BYTES


def vocab_bound(size: int) -> int:
    return size + len(SPECIALS)


def to_ids(rows: DataFrame, vocab: DataFrame, col: str = "token",
           unk_id: int = UNK_ID, bound: int | None = None) -> DataFrame:
    """Add ``id`` to token rows; tokens outside the vocabulary get ``unk_id``.

    Joined on leaf rows with the vocabulary broadcast (see ``vocab_side``).
    """
    v = vocab_side(vocab.select(F.col("token").alias(col), "id"), bound)
    return (rows.join(v, col, "left")
                .withColumn("id", F.coalesce(F.col("id"), F.lit(unk_id)).cast("int")))
