"""Query of operator 8 (tested against a brute-force version)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import scratch, table
from .weighted_sampling import as_text, edit, likeness, neighbours, sign, with_next


def op8_weighted_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = edit(neighbours(docs, "doc_id", "text")).select(
        "part", "rn", "key", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.col("text").alias("fp"), F.col("edited").alias("efp"))
    signed = scratch(sign(rows, ["part", "rn", "key", "n_chars", "edited_sha256"], ["fp", "efp"]), "fingerprints")
    return with_next(signed).select(
        F.col("key").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"))
