"""Query of operator 1 and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import scratch, table
from .secrets import findings, report, scan


def op1_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # a document is a repository of its owner, the source; one pass over the texts
    scanned = scratch(scan(docs, "doc_id", "text", "source", "doc_id"), "secret-spans")
    return report(scanned, findings(scanned)).withColumnRenamed("key", "doc_id")


def _spans(name, pattern, group, least, kind):
    return f"""{name} AS (SELECT doc_id, source, {kind} AS kind,
        regexp_split_to_array(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}') AS whole,
        regexp_extract_all(t, '{pattern}', {group}) AS val FROM base),
{name}_s AS (SELECT doc_id, source, kind, val[i] AS value,
        list_sum(list_transform(gap[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS s0, length(whole[i]) AS n
        FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM {name}) WHERE length(val[i]) >= {least})"""


_A = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL = f"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
{_spans('a', _A, 1, 12, 0)},
{_spans('k', 'AKIA[A-Z0-9]+', 0, 18, 1)},
{_spans('x', '[0-9a-f]+', 0, 16, 2)},
{_spans('w', '[A-Za-z0-9+/_=-]' + '{20,}', 0, 20, 3)},
b AS (SELECT * FROM a_s UNION ALL SELECT * FROM k_s UNION ALL SELECT * FROM x_s),
wide AS (SELECT * FROM w_s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w_s.doc_id AND b.s0 < w_s.s0 + w_s.n AND w_s.s0 < b.s0 + b.n)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM wide),
freq AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM c GROUP BY value),
f AS (SELECT c.*, CASE WHEN owners > 1 OR repos > 3 THEN 'example'
        WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
         AND len(list_distinct(string_split(value, ''))) >= least(length(value), 32) * 0.3 THEN 'live' ELSE 'unsure' END AS verdict
        FROM c JOIN freq USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s0::BIGINT || ':' || (s0 + n)::BIGINT, ',' ORDER BY s0, kind) FILTER (kind < 3) AS bs,
        string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s0::BIGINT || ':' || (s0 + n)::BIGINT, ',' ORDER BY s0, kind) FILTER (kind < 3 OR verdict = 'live') AS al,
        count(*) FILTER (kind < 3 AND verdict = 'live') AS n_live, count(*) FILTER (kind < 3 AND verdict = 'example') AS n_example
        FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN g USING (doc_id)
"""
