"""Query of operator 13 (tested against a brute-force version)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .alignment import alignments
from .common import table


def op13_alignment(spark, sf_dir):
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignments(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
