"""Query of operator 4 (tested by held-out accuracy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .toxicity import fit, fold_number, measured


def model_for(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter(F.col("toxic").isin(0, 1) & (fold_number("doc_id", 5) != 0))
    return fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, "doc_id", "text", "toxic")


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold_number("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    out = measured(docs, "text", model_for(spark, sf_dir), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
