"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_subdir

WORDS = r"[^\x20\x09-\x0D]+"        # fixed value: what counts as a word


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of the cluster and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the jobs before.
    """
    path = fresh_subdir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes on its way. ``drop`` deletes them once
    its result is written, so they don't pile up over the stages of a job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        path = fresh_subdir(self.spark, name)
        self.paths.append(path)
        df.write.options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []


def hash60(seed, *cols) -> Column:
    """Uniform integer in [0, 2^60): 15 hex digits of the md5 of the seed and
    the values, joined by ':'. A null counts as the word ``null``."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def word_count(col: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORDS)).cast("bigint"), F.lit(0).cast("bigint"))


def bits_for(rows: int, per_bucket: int = 4096) -> int:
    """log2 of the number of hash buckets that hold ``per_bucket`` rows each."""
    return max(0, math.ceil(math.log2(max(1, rows) / per_bucket)))


def broadcast_under(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast only when the counted ``rows`` stay under ``bound``; otherwise
    the join shuffles and AQE splits a skewed side."""
    return F.broadcast(df) if rows <= bound else df
