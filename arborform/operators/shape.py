"""Row filters and column choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import BASE_COLS, FEATURE_COLS, TREE_COLS


def exclude_lang(df: DataFrame, lang: str, col: str = "lang") -> DataFrame:
    """A2: drop rows of one language; rows without a language are kept.

    ``NOT (lang <=> v)`` is pushed to the parquet scan.
    """
    return df.filter(~F.col(col).eqNullSafe(F.lit(lang)))


def unsupported(df: DataFrame, langs, col: str = "lang", strict: bool = False) -> DataFrame:
    """A3: rows whose language is not in ``langs`` (a missing one included).

    The supported list is a literal set, so the test is a pushed-down
    ``NOT IN`` rather than a join. strict=True instead returns ``df`` with a
    check that fails the job on the first unsupported row.
    """
    bad = F.col(col).isNull() | ~F.col(col).isin(list(langs))
    if strict:
        # a filter predicate, so the optimizer cannot prune the check away
        return df.filter(F.when(bad, F.raise_error(
            F.concat(F.lit("language not in the supported list: "), F.coalesce(F.col(col), F.lit("null")))))
            .otherwise(F.lit(True)))
    return df.filter(bad)


def keep_features(df: DataFrame, key: str) -> DataFrame:
    """A4: key plus the derived feature columns (source columns dropped);
    pair frames keep both suffixed sides and ``labels``."""
    derived = set(FEATURE_COLS) | {f"{c}_{s}" for c in FEATURE_COLS for s in (1, 2)} | {"labels"}
    return df.select(key, *[c for c in df.columns if c != key and c in derived])


def model_columns(df: DataFrame, key: str, tree: bool, pair: bool = False) -> DataFrame:
    """A5: base columns, plus the tree columns when ``tree`` is on."""
    cols = list(BASE_COLS) + (list(TREE_COLS) if tree else [])
    if pair:
        cols = [f"{c}_{s}" for s in (1, 2) for c in cols] + ["labels"]
    return df.select(key, *cols)


def split_sizes(df: DataFrame, col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
