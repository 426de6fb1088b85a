"""Corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows that the stage before kept, and its output is written as Parquet and read
again. All but the last return the columns of ``docs``.

Defined results, of every stage: a null text counts as empty; an empty one is not
toxic, no near duplicate and not contaminated, and has size 0; null keys and
sources take part like others (a null source sorts last); repeated rows are
separate rows, of which near duplicates keep one if they have words; texts of any
length are read whole; further columns, whatever their names, are carried along;
of a group's documents with the same key the one of the smallest text hash stays;
empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborform.llm.common import Scratch, table, word_count
from arborform.llm.decontaminate import without_hits
from arborform.llm.interleave import add_shards
from arborform.llm.jaccard_join import one_of_each
from arborform.llm.mixing import mix
from arborform.llm.toxicity import fit, fold_number, without_toxic

SHARDS = 40

# The toxicity model is fitted and edit distances are verified inside tasks:
# SQL cannot express these stages. They are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon marks as toxic go. The model is
    fitted on the labelled ones of ``docs``."""
    labels = table(spark, sf_dir, "labels").filter(F.col("toxic").isin(0, 1) & (fold_number("doc_id", 5) != 0))
    return without_toxic(docs, "text", fit(docs, labels, "doc_id", "text", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return one_of_each(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within a few edits, go."""
    return without_hits(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: rows left out or repeated."""
    return mix(docs, "doc_id", "source", word_count("text")).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets the shard (0 to 39) that keeps the mixture in each."""
    return add_shards(docs, "doc_id", "source", SHARDS, "text")


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Scratch(spark)
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            before.drop()           # the stage before is not read again
        before = written
    return docs
