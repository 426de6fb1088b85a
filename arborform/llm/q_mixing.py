"""Query of operator 10 and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import scratch, table, word_count
from .mixing import BLOCK_BITS, BUDGET, CAP, SEED, SHARDS, keyed, place, plan


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the only pass over the texts: key, source and size
    rows = scratch(keyed(docs, "doc_id", "source", word_count("text")), "mix-rows")
    sources, blocks = plan(rows)
    out = place(rows, sources, blocks)
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                      (F.col("size") * F.size("copies")).cast("bigint").alias("taken"),
                      F.array_join(F.col("copies").cast("array<string>"), ",").alias("shards"))


def _hash(seed, *cols):
    parts = ", ".join([f"'{seed}'"] + [f"coalesce({c}::VARCHAR, 'null')" for c in cols])
    return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 15))::BIGINT"


def _tree():
    """The levels of the splitting tree, one after the other."""
    out = []
    for k in range((SHARDS - 1).bit_length()):
        out.append(f"""s{k + 1} AS (SELECT source, block, copy, CASE WHEN hi - lo > 1 AND NOT goes THEN mid ELSE lo END AS lo, CASE WHEN hi - lo > 1 AND goes THEN mid ELSE hi END AS hi
        FROM (SELECT *, (lo + hi) // 2 AS mid, row_number() OVER (PARTITION BY lo, hi ORDER BY {_hash(f'{SEED}-{k}', 'lo', 'source', 'block', 'copy')}, source NULLS FIRST, block, copy) * (hi - lo)
              <= count(*) OVER (PARTITION BY lo, hi) * ((lo + hi) // 2 - lo) AS goes FROM s{k}))""")
    return ",\n".join(out)


SQL = f"""
WITH d AS (SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w,
        sum(source_size) OVER () AS total FROM s),
c AS (SELECT *, source_size * {CAP}::DOUBLE AS lim, source_size * {CAP}::DOUBLE / w AS ratio FROM w),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM c),
l AS (SELECT *, (total * {BUDGET}::DOUBLE - filled) / open_w AS lv FROM o),
t AS (SELECT source, source_size, least(lim, coalesce((SELECT max(lv) FROM l WHERE lv <= ratio) * w, lim)) AS target FROM l),
b AS (SELECT *, floor(target / greatest(source_size, 1))::INTEGER AS base,
        target - floor(target / greatest(source_size, 1))::INTEGER * source_size AS rest FROM t),
bl AS (SELECT source, (h >> {60 - BLOCK_BITS})::INTEGER AS block, sum(size)::BIGINT AS block_size FROM d GROUP BY ALL),
s0 AS (SELECT bl.source, block, unnest(range(1, base + CASE WHEN rest > 0 THEN 1 ELSE 0 END + 1)) AS copy, 0 AS lo, {SHARDS} AS hi
        FROM bl JOIN b ON bl.source IS NOT DISTINCT FROM b.source),
{_tree()},
q AS (SELECT source, lo AS shard, count(*) AS q FROM s{(SHARDS - 1).bit_length()} GROUP BY ALL),
runs AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
drawn AS (SELECT source, block, copy, row_number() OVER (PARTITION BY source ORDER BY {_hash(f'{SEED}-draw', 'source', 'block', 'copy')}, block, copy) AS p FROM s{(SHARDS - 1).bit_length()}),
home AS (SELECT drawn.source, block, copy, shard, p - before AS place FROM drawn JOIN runs ON drawn.source IS NOT DISTINCT FROM runs.source AND p > before AND p <= before + q),
parts AS (SELECT home.source, home.block, rest, block_size,
        coalesce(sum(block_size) OVER (PARTITION BY home.source ORDER BY place, shard, home.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM home JOIN b ON home.source IS NOT DISTINCT FROM b.source AND copy = base + 1 JOIN bl ON bl.source IS NOT DISTINCT FROM home.source AND bl.block = home.block),
part AS (SELECT *, CASE WHEN ahead + block_size < rest THEN 2 WHEN ahead < rest THEN 1 ELSE 0 END AS part FROM parts),
r AS (SELECT d.*, b.source_size, b.target, b.base, b.rest, (h >> {60 - BLOCK_BITS})::INTEGER AS block FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
rp AS (SELECT r.*, coalesce(part.part, 0) AS part, part.ahead FROM r LEFT JOIN part ON part.source IS NOT DISTINCT FROM r.source AND part.block = r.block),
inside AS (SELECT source, h, ahead + sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, rest FROM rp WHERE part = 1),
cut AS (SELECT b.source, coalesce((SELECT max(h) FROM inside WHERE upto <= inside.rest AND inside.source IS NOT DISTINCT FROM b.source), -1) AS hc,
        b.rest - coalesce((SELECT max(upto) FROM inside WHERE upto <= inside.rest AND inside.source IS NOT DISTINCT FROM b.source),
                          (SELECT max(ahead) FROM part WHERE part.part = 1 AND part.source IS NOT DISTINCT FROM b.source), 0) AS gap FROM b),
took AS (SELECT rp.*, hc, gap, (part = 2 OR (part = 1 AND h <= hc)) AS reached FROM rp JOIN cut ON rp.source IS NOT DISTINCT FROM cut.source),
behind AS (SELECT source, h, any_value(gap) AS gap, abs(any_value(gap) - sum(size)) AS off FROM took WHERE NOT reached AND gap > 0 GROUP BY source, h),
extra AS (SELECT source, arg_min(h, (off, h)) AS hx FROM behind WHERE off < gap GROUP BY source),
took2 AS (SELECT took.*, base + CASE WHEN reached OR h = coalesce(hx, -1) THEN 1 ELSE 0 END AS n FROM took LEFT JOIN extra ON took.source IS NOT DISTINCT FROM extra.source),
hm AS (SELECT source, block, list(shard ORDER BY copy) AS shards FROM home GROUP BY source, block)
SELECT doc_id, size, source_size, target, (size * n)::BIGINT AS taken, coalesce(array_to_string(hm.shards[1:n], ','), '') AS shards
FROM took2 LEFT JOIN hm ON hm.source IS NOT DISTINCT FROM took2.source AND hm.block = took2.block
"""
