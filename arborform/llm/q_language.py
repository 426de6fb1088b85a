"""Query of operator 2 (tested by held-out accuracy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .language import fit, predict
from .toxicity import fold_number


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold_number("doc_id", 4) == 2, F.lit(False))
    train = docs.select("doc_id", "text", "lang").filter(~held)
    model = fit(train, "doc_id", "lang", "text")
    return predict(docs.select("doc_id", "text", held.alias("held_out")), "text", model, keep=("doc_id", "held_out"))
