"""Query of operator 6 (tested by an exact round trip)."""

from __future__ import annotations

import public_tokenizers

from ..session import fresh_subdir
from .common import table
from .token_table import with_starts, write_tokens

TOKENIZER = "byte_bpe_50k.json"


def op6_token_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = write_tokens(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), fresh_subdir(spark, "tokens"))
    return with_starts(spark, path, "doc_id")
