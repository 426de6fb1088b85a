"""Query of operator 3 and its SQL (the same scores by a loop of its own)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .linkrank import DAMPING, DOMAIN_TIE, THRESHOLD, judge


def op3_linkrank(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = judge(pages, "url", "html")
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def _rank(name, seed, src, dst):
    """Scores as one list by host number; a step is a list of sums over incoming edges. Floats, run far past convergence."""
    return f"""{name}_e AS (SELECT a.i AS src, b.i AS dst, w / sum(w) OVER (PARTITION BY graph.{src}) AS share
        FROM graph JOIN node a ON a.host = graph.{src} JOIN node b ON b.host = graph.{dst}),
{name}_in AS (SELECT node.i, any_value(coalesce({seed}, 0)) AS seed, coalesce(list(src ORDER BY src) FILTER (src IS NOT NULL), []) AS srcs,
        coalesce(list(share ORDER BY src) FILTER (src IS NOT NULL), []) AS shares
        FROM node LEFT JOIN hosts ON hosts.host = node.host LEFT JOIN {name}_e ON dst = node.i GROUP BY node.i),
{name}_g AS (SELECT list({{'srcs': srcs, 'shares': shares, 'seed': seed::DOUBLE}} ORDER BY i) AS ins, list(seed::DOUBLE ORDER BY i) AS s0 FROM {name}_in),
{name}_r AS (SELECT 0 AS step, s0 AS s FROM {name}_g UNION ALL
        SELECT step + 1, list_transform(ins, lambda x: {1 - DAMPING}::DOUBLE * x.seed + {DAMPING}::DOUBLE * coalesce(list_sum(list_transform(x.srcs, lambda j, k: s[j] * x.shares[k])), 0))
        FROM {name}_r, {name}_g WHERE step < 300),
{name}_s AS (SELECT s, greatest(list_sum(s), 1e-300) AS total FROM {name}_r WHERE step = 300)"""


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOW.format("regexp_extract(coalesce({}, ''), '^(?s:.*?)://([^/?#]*)', 1)")
SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_HOST.format('url')} AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM r),
hosts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM v WHERE host <> '' GROUP BY host),
l AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS t FROM v WHERE host <> ''),
d AS (SELECT host AS src, CASE WHEN regexp_matches(t, '^(?i)https?://') THEN {_HOST.format('t')}
        WHEN t LIKE '//%' THEN {_HOST.format("'http:' || t")} ELSE host END AS dst FROM l),
links AS (SELECT src, dst, count(*) AS n FROM d WHERE dst <> '' GROUP BY src, dst),
up AS (SELECT host, string_split(host, '.') AS parts FROM (SELECT host FROM hosts UNION SELECT dst FROM links) WHERE len(string_split(host, '.')) > 2),
chain AS (SELECT parts, unnest(range(1, len(parts) - 1)) AS i FROM up),
ups AS (SELECT DISTINCT array_to_string(parts[i:], '.') AS src, array_to_string(parts[i + 1:], '.') AS dst FROM chain),
ties AS (SELECT src, dst, coalesce((SELECT sum(n) FROM links WHERE links.src = b.src), 1) * {DOMAIN_TIE}::DOUBLE AS w
        FROM (SELECT src, dst FROM ups UNION ALL SELECT dst, src FROM ups) b),
graph AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, n::DOUBLE AS w FROM links UNION ALL SELECT * FROM ties) GROUP BY src, dst),
node AS (SELECT host, row_number() OVER (ORDER BY host) AS i FROM (SELECT host FROM hosts UNION SELECT src FROM graph UNION SELECT dst FROM graph)),
{_rank('t', 'good', 'src', 'dst')},
{_rank('b', 'bad', 'dst', 'src')},
score AS (SELECT node.host, t_s.s[node.i] / t_s.total AS t, b_s.s[node.i] / b_s.total AS b FROM node, t_s, b_s)
SELECT page_id, v.host, path, rule, coalesce(verdict, CASE WHEN coalesce(score.b, 0) > coalesce(score.t, 0) * {THRESHOLD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN score ON v.host = score.host
"""
