"""Split tables in and out.

A split table is parquet partitioned by a ``split`` column; reading one
split prunes the other folders at planning time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """One table of the test layout (``<dir>/<name>.parquet``)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A1: the whole split table, or one split (partition-pruned)."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == F.lit(split))


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a split table partitioned by ``split`` (parquet)."""
    (df.write.mode(mode).partitionBy("split").parquet(path))
    return path


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``key`` before per-row work whose rows are
    grouped by the same key later: the exchange moves whole texts instead of
    one row per leaf, and the grouping needs none. The caller decides; the plan
    is the same for every input size."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)
