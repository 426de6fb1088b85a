"""Query of operator 9 (tested against a brute-force version)."""

from __future__ import annotations

from .common import table
from .decontaminate import hits


def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return (hits(docs, "doc_id", "text", items, "item_id", "text")
            .withColumnRenamed("key", "doc_id").withColumnRenamed("item", "item_id"))
