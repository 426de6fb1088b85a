"""Query of operator 12 (tested against the library's own encoding and decoding)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe_trie import encode
from .common import table


def op12_bpe_trie(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, "doc_id", "text", path, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
