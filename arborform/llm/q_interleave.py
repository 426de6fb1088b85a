"""Query of operator 7 and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .interleave import SEED, interleave

SHARDS = 40


def op7_interleave(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source",
                       (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(rows, "doc_id", "source", SHARDS, tie=F.col("text_crc32"), carry=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


# crc32 is folded over the bytes bit by bit: 3988292384 is its polynomial.
SQL = f"""
WITH bit AS (SELECT i, list_reduce([i]::BIGINT[] || [0,0,0,0,0,0,0,0]::BIGINT[],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bit),
base AS (SELECT doc_id, source, coalesce(text, '') AS text,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
crc AS (SELECT doc_id, source, h, octet_length(encode(text)) + 16 AS size,
        xor(list_reduce([4294967295]::BIGINT[] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
        FROM base, tab),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1) + 1)::DOUBLE
        / (2 * count(*) OVER (PARTITION BY source)) AS f FROM crc),
g AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS LAST, h, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, ((pos * {SHARDS}) // n)::INTEGER AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard,
       (pos - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
