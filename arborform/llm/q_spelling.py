"""Query of operator 11 and its SQL."""

from __future__ import annotations

from .common import table
from .spelling import corpus_words, variants


def op11_spelling(spark, sf_dir):
    words = corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", noise=97)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 is folded over the bytes: 3988292384 is its polynomial.
SQL = r"""
WITH RECURSIVE bit AS (SELECT i, list_reduce([i]::BIGINT[] || [0,0,0,0,0,0,0,0]::BIGINT[],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bit),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
occ AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS k FROM runs GROUP BY ALL),
crc AS (SELECT run, k, xor(list_reduce([4294967295]::BIGINT[] || list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM occ, tab),
cut AS (SELECT run, k, h % 97 = 0 AS drops, (h % length(run))::BIGINT AS i FROM crc),
w AS (SELECT CASE WHEN drops THEN substr(run, 1, i) || substr(run, i + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM cut GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
e AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
r AS MATERIALIZED (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS g FROM e),
d AS MATERIALIZED (SELECT DISTINCT e.word, v.word AS other FROM e JOIN v ON v.word = substr(e.word, 1, i - 1) || substr(e.word, i + 1)),
near AS (SELECT a.word, b.word AS other FROM r a JOIN r b ON a.g = b.g AND a.word <> b.word UNION SELECT word, other FROM d UNION SELECT other, word FROM d),
best AS (SELECT near.word, count(*)::BIGINT AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS other_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
        CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
p AS (SELECT word, word AS root FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word JOIN f g ON g.word = p.root WHERE g.form IS NULL
"""
