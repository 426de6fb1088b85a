"""DuckDB SQL for each named query (the independent oracle).

Written from the operator definitions, not from the Spark plans. Arrays are
emitted as ','-joined text; vectors as integers x * 10^6 rounded.
"""

from __future__ import annotations

from ..operators.trees import MARKUP_PATTERN, NEST_TAGS, RAW_PATTERN, TAG_NAME_PATTERN, \
    TOKEN_PATTERN, WORD_PATTERN
from . import params as P

BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def draw_sql(*parts: str, slot: int = 0) -> str:
    inner = ", ".join([q(str(P.SEED))] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5(concat_ws(':', {inner})), {1 + 8 * slot}, 8))::BIGINT)"


def leaves_expr(text: str = "text") -> str:
    pat = q(TOKEN_PATTERN)
    return f"""CASE WHEN {text} IS NULL THEN NULL
      WHEN {text} = '' THEN [{{'token': {text}, 'depth': 0, 'sib': 0}}]
      ELSE flatten(list_transform(string_split({text}, chr(10)), lambda l, i:
        CASE WHEN len(regexp_extract_all(l, {pat})) = 0
             THEN [{{'token': l, 'depth': 1, 'sib': CAST(i - 1 AS INTEGER)}}]
             ELSE list_transform(regexp_extract_all(l, {pat}),
                  lambda t, j: {{'token': t, 'depth': 2, 'sib': CAST(j - 1 AS INTEGER)}}) END))
    END"""


def docs_cte(exclude: bool) -> str:
    where = f"WHERE lang IS DISTINCT FROM {q(P.EXCLUDED_LANG)}" if exclude else ""
    return f"docs AS (SELECT doc_id, text, lang FROM documents {where})"


def leaf_rows_cte() -> str:
    """lv(doc_id, text, leaves) and lrows(doc_id, leaf_pos, token, depth, sib)."""
    return f"""lv AS (SELECT doc_id, text, {leaves_expr()} AS leaves FROM docs),
lrows AS (SELECT doc_id, u.leaf_pos AS leaf_pos, u.token AS token, u.depth AS depth, u.sib AS sib
  FROM (SELECT doc_id, unnest(list_transform(leaves, lambda x, i:
          {{'leaf_pos': CAST(i - 1 AS INTEGER), 'token': x.token, 'depth': x.depth, 'sib': x.sib}})) AS u
        FROM lv))"""


def vocab_cte(src: str = "lrows") -> str:
    specials = " UNION ALL ".join(
        f"SELECT {q(t)} AS token, CAST({i} AS INTEGER) AS id"
        for t, i in [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("<mask>", 4)])
    return f"""counts AS (SELECT token, count(*) AS n FROM {src}
  WHERE trim(token, {BLANK}) <> '' AND token NOT IN ('<s>', '<pad>', '</s>', '<unk>', '<mask>')
  GROUP BY token),
vocab AS (SELECT token, CAST(4 + rk AS INTEGER) AS id FROM
    (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rk FROM counts) WHERE rk <= {P.VOCAB_SIZE}
  UNION ALL {specials})"""


def align_expr(leaves: str, ref: str) -> str:
    return f"""list_transform(string_split(list_reduce({leaves}, lambda acc, x:
      CASE WHEN acc.p <= len({ref})
           THEN (CASE WHEN {ref}[acc.p] = x THEN {{'p': acc.p + 1, 'm': acc.m || '1'}}
                      ELSE {{'p': acc.p, 'm': acc.m || '0'}} END)
           ELSE {{'p': acc.p, 'm': acc.m || '1'}} END,
      {{'p': 1, 'm': ''}}).m, ''), lambda c: CAST(c AS INTEGER))"""


def leaf_features(table_sql: str, key: str) -> str:
    """Feature rows from rows lrows(key, leaf_pos from 0, token, depth, sib):
    cut, aligned with the words of all kept leaves, looked up, wrapped, padded."""
    L = P.SEQ_LEN
    mask = align_expr("list_transform(cut, lambda x: x.token)", "ref")
    ctes = f"""{vocab_cte()},
gl AS (SELECT {key}, list({{'token': token, 'depth': depth, 'sib': sib}} ORDER BY leaf_pos)[1:{L - 2}] AS cut,
         list(token ORDER BY leaf_pos) AS toks FROM lrows GROUP BY {key}),
cutt AS (SELECT {key}, cut, flatten(list_transform(toks, lambda x: regexp_extract_all(x, {q(WORD_PATTERN)})))[1:{L - 2}] AS ref FROM gl),
masked AS (SELECT {key}, cut, {mask} AS mask FROM cutt),
krows AS (SELECT {key}, u.* FROM (SELECT {key}, unnest(list_transform(cut, lambda x, i:
          {{'pos': i, 'token': x.token, 'depth': x.depth, 'sib': x.sib, 'm': mask[i]}})) AS u FROM masked)),
idrows AS (SELECT k.*, coalesce(v.id, 3) AS id FROM krows k LEFT JOIN vocab v ON k.token = v.token),
wrapped AS (SELECT {key}, [0] || list(id ORDER BY pos) || [2] AS w_ids, [-1] || list(depth ORDER BY pos) || [-1] AS w_dep,
          [-1] || list(sib ORDER BY pos) || [-1] AS w_sib, [0] || list(m ORDER BY pos) || [0] AS w_tm FROM idrows GROUP BY {key}),
feats AS (SELECT {key},
   w_ids || list_transform(range({L} - len(w_ids)), lambda x: 0) AS input_ids,
   list_transform(w_ids, lambda x: 1) || list_transform(range({L} - len(w_ids)), lambda x: 0) AS attention_mask,
   w_dep || list_transform(range({L} - len(w_dep)), lambda x: -1) AS depths,
   w_sib || list_transform(range({L} - len(w_sib)), lambda x: -1) AS sibling_indices,
   w_tm || list_transform(range({L} - len(w_tm)), lambda x: 0) AS tree_attention_mask FROM wrapped)"""
    return f"WITH lrows AS ({table_sql}),\n{ctes}\nSELECT {key}, {FEATURE_TEXT} FROM feats"


def features_ctes(align: bool = True, L: int = P.SEQ_LEN) -> str:
    """docs -> feats(doc_id, ids, att, dep, sib, tm) as lists (unpadded: raw_*)."""
    if align:
        mask = align_expr("list_transform(cut, lambda x: x.token)", "ref")
    else:
        mask = "list_transform(cut, lambda x: 1)"
    return f"""{leaf_rows_cte()},
{vocab_cte()},
cutt AS (SELECT doc_id, leaves[1:{L - 2}] AS cut,
           regexp_extract_all(text, {q(WORD_PATTERN)})[1:{L - 2}] AS ref FROM lv),
masked AS (SELECT doc_id, cut, {mask} AS mask FROM cutt),
krows AS (SELECT doc_id, u.pos AS pos, u.token AS token, u.depth AS depth, u.sib AS sib, u.m AS m
  FROM (SELECT doc_id, unnest(list_transform(cut, lambda x, i:
          {{'pos': i, 'token': x.token, 'depth': x.depth, 'sib': x.sib, 'm': mask[i]}})) AS u FROM masked)),
idrows AS (SELECT k.*, coalesce(v.id, 3) AS id FROM krows k LEFT JOIN vocab v ON k.token = v.token),
grp AS (SELECT doc_id, list(id ORDER BY pos) AS ids, list(depth ORDER BY pos) AS dep,
          list(sib ORDER BY pos) AS sb, list(m ORDER BY pos) AS tm FROM idrows GROUP BY doc_id),
wrapped AS (SELECT doc_id, [0] || ids || [2] AS w_ids, [-1] || dep || [-1] AS w_dep,
          [-1] || sb || [-1] AS w_sib, [0] || tm || [0] AS w_tm FROM grp),
feats AS (SELECT doc_id,
   w_ids || list_transform(range({L} - len(w_ids)), lambda x: 0) AS input_ids,
   list_transform(w_ids, lambda x: 1) || list_transform(range({L} - len(w_ids)), lambda x: 0) AS attention_mask,
   w_dep || list_transform(range({L} - len(w_dep)), lambda x: -1) AS depths,
   w_sib || list_transform(range({L} - len(w_sib)), lambda x: -1) AS sibling_indices,
   w_tm || list_transform(range({L} - len(w_tm)), lambda x: 0) AS tree_attention_mask
  FROM wrapped)"""


def txt(col: str, alias: str | None = None) -> str:
    return f"array_to_string({col}, ',') AS {alias or col}"


FEATURE_TEXT = ", ".join(txt(c) for c in ["input_ids", "attention_mask", "depths",
                                          "sibling_indices", "tree_attention_mask"])


def sql_queries() -> dict[str, str]:
    S: dict[str, str] = {}
    S["exclude_lang"] = f"""SELECT doc_id, lang FROM documents
        WHERE lang IS DISTINCT FROM {q(P.EXCLUDED_LANG)}"""
    langs = ", ".join(q(x) for x in P.SUPPORTED_LANGS)
    S["unsupported_lang"] = f"""SELECT doc_id, lang FROM documents
        WHERE lang IS NULL OR lang NOT IN ({langs})"""
    S["layout_leaves"] = f"""WITH {docs_cte(False)}, {leaf_rows_cte()}
        SELECT doc_id, leaf_pos, token, depth, sib FROM lrows"""
    S["vocab"] = f"""WITH {docs_cte(False)}, {leaf_rows_cte()}, {vocab_cte()}
        SELECT token, id FROM vocab"""
    S["vocab_frequent"] = S["vocab"]
    S["token_ids"] = f"""WITH {docs_cte(False)}, {leaf_rows_cte()}, {vocab_cte()}
        SELECT l.doc_id, l.leaf_pos, l.token, coalesce(v.id, 3) AS id
        FROM lrows l LEFT JOIN vocab v ON l.token = v.token"""
    S["align_mask"] = f"""WITH {docs_cte(False)},
      toks AS (SELECT doc_id, regexp_extract_all(text, {q(TOKEN_PATTERN)}) AS lt,
                      regexp_extract_all(text, {q(WORD_PATTERN)}) AS ref FROM docs),
      al AS (SELECT doc_id, {align_expr('lt', 'ref')} AS mask FROM toks)
      SELECT doc_id, CAST(u.pos AS INTEGER) AS pos, u.m AS mask
      FROM (SELECT doc_id, unnest(list_transform(mask, lambda m, i: {{'pos': i - 1, 'm': m}})) AS u FROM al)"""
    S["features"] = f"""WITH {docs_cte(True)}, {features_ctes()}
        SELECT doc_id, {FEATURE_TEXT} FROM feats"""
    S["features_ref"] = S["features"].replace(f"regexp_extract_all(text, {q(WORD_PATTERN)})[1:{P.SEQ_LEN - 2}] AS ref",
        f"regexp_extract_all(left(text, (length(text) // 2)::INTEGER), {q(WORD_PATTERN)})[1:{P.SEQ_LEN - 2}] AS ref")
    more_queries(S)
    return S


U32 = "4294967296.0"


def split_expr(key: str = "doc_id") -> str:
    u = f"({draw_sql(key)} / {U32})"
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'validation' ELSE 'test' END"


def half_draw(key: str = "doc_id") -> str:
    return draw_sql("'half'", key)


FEAT = f"WITH {docs_cte(True)}, {features_ctes()}"
TAGS = ", ".join(q(t) for t in NEST_TAGS)


def pos_id_expr(ids: str, i: str) -> str:
    """position id at 1-based index i of list ids (pad id 1)."""
    return (f"(CASE WHEN {ids}[{i}] = 1 THEN 1 ELSE "
            f"CAST(len(list_filter({ids}[1:{i}], lambda y: y <> 1)) AS INTEGER) + 1 END)")


def num_text_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(round(x * 1000000.0) AS BIGINT)), ',')"


def slots_cte() -> str:
    o = P.VEC_OFFSETS
    m = "(SELECT count(*) FROM embeddings)"
    joins = "\n    ".join(f"LEFT JOIN vt {x} ON {x}.vec_id = (s.{src}_id + {o[src]}) % {m}" for x, src in zip(
        "abcde", ("word", "type", "position", "depth", "sibling")))
    return f"""pids AS (SELECT doc_id, list_transform(range(1, {P.SEQ_LEN + 1}), lambda i:
        {pos_id_expr('input_ids', 'i')}) AS pid FROM feats),
slots AS (SELECT f.doc_id, CAST(i - 1 AS INTEGER) AS pos, input_ids[i] AS word_id, 0 AS type_id, pid[i] AS position_id,
      greatest(depths[i], 0) AS depth_id, greatest(sibling_indices[i], 0) AS sibling_id,
      CAST((depths[i] <> -1) AS INTEGER) * tree_attention_mask[i] AS depth_on,
      CAST((sibling_indices[i] <> -1) AS INTEGER) * tree_attention_mask[i] AS sib_on
    FROM feats f JOIN pids USING (doc_id), range(1, {P.SEQ_LEN + 1}) r(i)),
vt AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
tv AS (SELECT s.*, a.vec AS word_vec, b.vec AS type_vec, c.vec AS position_vec, d.vec AS depth_vec,
              e.vec AS sibling_vec FROM slots s
    {joins})"""


def digest_sql(v: str) -> str:
    return f"md5({num_text_sql(v)})"


def fused_sql(how: str) -> str:
    k = "list_transform(range(1, len(word_vec) + 1), lambda k: "
    don, son = "CAST(depth_on AS DOUBLE)", "CAST(sib_on AS DOUBLE)"
    if how == "sum":
        v = (f"{k}((((word_vec[k] + type_vec[k]) + position_vec[k]) + depth_vec[k] * {don})"
             f" + sibling_vec[k] * {son}))")
    elif how == "weighted":
        w = P.FUSE_WEIGHTS
        v = (f"{k}((((word_vec[k] * {w['word']!r} + type_vec[k] * {w['type']!r}) + "
             f"position_vec[k] * {w['position']!r}) + (depth_vec[k] * {don}) * {w['depth']!r}) + "
             f"(sibling_vec[k] * {son}) * {w['sibling']!r}))")
    elif how == "concat":
        v = (f"word_vec || type_vec || position_vec || list_transform(depth_vec, lambda x: x * {don})"
             f" || list_transform(sibling_vec, lambda x: x * {son})")
    else:
        return f"""{FEAT}, {slots_cte()},
          f AS (SELECT doc_id, pos, {fused_inner('sum')} AS v FROM tv),
          m AS (SELECT doc_id, pos, v, list_reduce(v, lambda a, x: a + x, 0.0) / len(v) AS mean FROM f),
          sd AS (SELECT doc_id, pos, v, mean,
                   sqrt(list_reduce(v, lambda a, x: a + (x - mean) * (x - mean), 0.0) / len(v) + {P.LN_EPS!r}) AS sd
                 FROM m)
          SELECT doc_id, pos, {digest_sql('list_transform(v, lambda x: (x - mean) / sd)')} AS vec FROM sd"""
    return f"{FEAT}, {slots_cte()} SELECT doc_id, pos, {digest_sql(v)} AS vec FROM tv"


def fused_inner(how: str) -> str:
    don, son = "CAST(depth_on AS DOUBLE)", "CAST(sib_on AS DOUBLE)"
    return (f"list_transform(range(1, len(word_vec) + 1), lambda k: ((((word_vec[k] + type_vec[k]) + "
            f"position_vec[k]) + depth_vec[k] * {don}) + sibling_vec[k] * {son}))")


PRED = f"""preds AS (SELECT vec_id, CAST(embedding[1:{P.N_CLASSES}] AS DOUBLE[]) AS logits,
             CAST(label AS INTEGER) AS label FROM embeddings),
wp AS (SELECT vec_id, logits, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
       FROM preds),
rl AS (SELECT vec_id, label,
         list_max(logits) + ln(list_reduce(list_transform(logits, lambda x: exp(x - list_max(logits))),
                                           lambda a, x: a + x, 0.0)) - logits[label + 1] AS loss
       FROM preds WHERE label <> -100),
cnt AS (SELECT label AS l, pred AS p, count(*) AS n FROM wp GROUP BY 1, 2),
bl AS (SELECT l AS cls, sum(n) AS support, sum(CASE WHEN l = p THEN n ELSE 0 END) AS tp FROM cnt GROUP BY 1),
bp AS (SELECT p AS cls, sum(n) AS predicted FROM cnt GROUP BY 1),
rep0 AS (SELECT CAST(coalesce(bl.cls, bp.cls) AS INTEGER) AS cls,
           CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted,
           CAST(coalesce(tp, 0) AS BIGINT) AS tp FROM bl FULL OUTER JOIN bp ON bl.cls = bp.cls),
rep AS (SELECT cls, support, predicted, tp,
           CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
           CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
        FROM rep0)"""


def more_queries(S: dict) -> None:
    S["source_split"] = f"""SELECT doc_id, lang, split FROM
        (SELECT doc_id, lang, {split_expr()} AS split FROM documents) WHERE split = 'validation'"""
    S["json_split"] = f"""SELECT doc_id, lang, split, md5(text) AS text_md5 FROM (SELECT doc_id, lang, text, {split_expr()} AS split FROM documents)
        WHERE split = 'validation' AND lang IS DISTINCT FROM {q(P.EXCLUDED_LANG)}"""
    S["split_sizes"] = f"""SELECT split, count(*) AS n_rows FROM
        (SELECT {split_expr()} AS split FROM documents) GROUP BY split"""
    every = f"WITH {docs_cte(False)}, {features_ctes()}"
    S["keep_features"] = f"{every} SELECT doc_id, {FEATURE_TEXT} FROM feats"
    S["model_columns_base"] = f"""{every} SELECT doc_id, {txt('input_ids')}, {txt('attention_mask')}
        FROM feats"""
    S["model_columns_tree"] = f"{every} SELECT doc_id, {FEATURE_TEXT} FROM feats"
    S["feature_sink"] = f"""{FEAT} SELECT doc_id, {split_expr()} AS split, {FEATURE_TEXT} FROM feats"""
    half = f"""(SELECT doc_id, {half_draw()} AS d,
          CASE WHEN row_number() OVER (ORDER BY {half_draw()}, doc_id) - 1 < floor(count(*) OVER () / 2)
               THEN 'valid' ELSE 'test' END AS part FROM {{src}})"""
    S["half_split"] = f"SELECT doc_id, part FROM {half.format(src='documents')}"
    S["first_n"] = f"""SELECT doc_id FROM {half.format(src='documents')} WHERE part = 'valid'
        ORDER BY d, doc_id LIMIT {P.VALID_CUT}"""
    S["assemble"] = f"""WITH lab AS (SELECT doc_id, {split_expr()} AS split FROM documents),
        rest AS (SELECT doc_id FROM lab WHERE split <> 'train'),
        h AS {half.format(src='rest')}
        SELECT doc_id, 'train' AS split FROM lab WHERE split = 'train'
        UNION ALL SELECT doc_id, 'valid' AS split FROM h WHERE part = 'valid'
        UNION ALL SELECT doc_id, 'test' AS split FROM h WHERE part = 'test'"""
    # windows over well-formed pages; the query itself walks with a stack of open tags
    S["markup_leaves"] = f"""WITH toks AS (
        SELECT page_id, u.pos AS pos, u.t AS token FROM (
          SELECT page_id, unnest(list_transform(regexp_extract_all(html, {q(MARKUP_PATTERN)}),
                   lambda t, i: {{'pos': i - 1, 't': t}})) AS u FROM pages)),
      cls AS (SELECT page_id, pos, token, lower(regexp_extract(token, {q(TAG_NAME_PATTERN)}, 1)) AS name FROM toks),
      kinds AS (SELECT page_id, pos, token,
        CASE WHEN starts_with(token, '<!') THEN 'drop'
             WHEN regexp_matches(token, {q(RAW_PATTERN)}) THEN 'leaf'
             WHEN name <> '' AND name NOT IN ({TAGS}) THEN 'drop'
             WHEN name <> '' AND starts_with(token, '</') THEN 'close'
             WHEN name <> '' AND ends_with(token, '/>') THEN 'leaf'
             WHEN name <> '' THEN 'open'
             WHEN trim(token, {BLANK}) = '' THEN 'drop'
             ELSE 'leaf' END AS kind FROM cls),
      k2 AS (SELECT * FROM kinds WHERE kind <> 'drop'),
      run AS (SELECT *, CAST(sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END)
                OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS s,
              lead(kind) OVER (PARTITION BY page_id ORDER BY pos) AS next_kind FROM k2),
      nodes AS (SELECT page_id, pos, token, kind, CASE WHEN kind = 'open' THEN s - 1 ELSE s END AS depth,
                  (kind = 'leaf' OR coalesce(next_kind = 'close', true)) AS is_leaf FROM run WHERE kind <> 'close'),
      placed AS (SELECT page_id, pos, token, depth, is_leaf, depth AS grp, false AS marker FROM nodes
                 UNION ALL SELECT page_id, pos, token, depth, is_leaf, depth + 1, true FROM nodes WHERE kind = 'open'),
      par AS (SELECT *, coalesce(max(CASE WHEN marker THEN pos END) OVER (PARTITION BY page_id, grp ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS parent FROM placed),
      sb AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, grp, parent ORDER BY pos) - 1 AS INTEGER) AS sib
             FROM par WHERE NOT marker)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS leaf_pos,
             token, CAST(depth AS INTEGER) AS depth, sib FROM sb WHERE is_leaf
      UNION ALL SELECT page_id, 0, coalesce(html, ''), 0, 0 FROM pages WHERE page_id NOT IN (SELECT page_id FROM sb WHERE is_leaf)"""
    S["node_paths"] = """WITH RECURSIVE nodes AS (
        SELECT CAST(r_regionkey AS BIGINT) * 4 AS node_id, CAST(NULL AS BIGINT) AS parent_id,
               CAST(r_regionkey AS BIGINT) AS ord, r_name AS text FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 1, CAST(n_regionkey AS BIGINT) * 4,
               CAST(n_nationkey AS BIGINT), n_name FROM nation
        UNION ALL SELECT c_custkey * 4 + 2, CAST(c_nationkey AS BIGINT) * 4 + 1, c_custkey, c_name FROM customer
        UNION ALL SELECT o_orderkey * 4 + 3, o_custkey * 4 + 2, o_orderkey, o_orderpriority FROM orders),
      walk(node_id, root_id, depth, path) AS (
        SELECT node_id, node_id, 0, [ord] FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.node_id, w.root_id, w.depth + 1, list_append(w.path, n.ord)
        FROM nodes n JOIN walk w ON n.parent_id = w.node_id),
      sibs AS (SELECT node_id, text, CASE WHEN parent_id IS NULL THEN 0
                 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) - 1 END AS sib FROM nodes)
      SELECT w.node_id, w.root_id, CAST(w.depth AS INTEGER) AS depth, CAST(s.sib AS INTEGER) AS sib,
             array_to_string(w.path, ',') AS path, s.text
      FROM walk w JOIN sibs s ON w.node_id = s.node_id
      WHERE w.node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)"""
    paths = "list_transform(string_split(path, ','), lambda x: x::BIGINT)"
    S["node_leaves"] = f"""SELECT node_id, root_id, row_number() OVER (PARTITION BY root_id ORDER BY {paths}) - 1 AS leaf_pos, depth, sib, text
        FROM ({S['node_paths']})"""
    # every node, whether it has children or not
    S["node_order"] = f"""SELECT node_id, root_id, row_number() OVER (PARTITION BY root_id ORDER BY {paths}) - 1 AS pre, depth, sib,
        CASE WHEN leaf THEN count(*) FILTER (WHERE leaf) OVER (PARTITION BY root_id ORDER BY {paths} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS leaf_pos
        FROM ({S['node_paths'].replace("array_to_string(w.path, ',') AS path, s.text", "array_to_string(w.path, ',') AS path, w.node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS leaf").rsplit('WHERE w.node_id NOT IN', 1)[0]})"""
    S["markup_features"] = leaf_features(S["markup_leaves"], "page_id")
    S["node_features"] = leaf_features(f"SELECT root_id, leaf_pos, text AS token, depth, sib FROM ({S['node_leaves']})", "root_id")
    S["leaf_arrays"] = f"""WITH {docs_cte(False)}, {leaf_rows_cte()}
        SELECT doc_id, array_to_string(list(token ORDER BY leaf_pos), chr(31)) AS tokens,
          array_to_string(list(1 ORDER BY leaf_pos), ',') AS tree_mask,
          array_to_string(list(depth ORDER BY leaf_pos), ',') AS depths,
          array_to_string(list(sib ORDER BY leaf_pos), ',') AS sibs FROM lrows GROUP BY doc_id"""
    S["leaf_arrays_walk"] = S["leaf_arrays"]
    S["truncate"] = f"""WITH {docs_cte(True)}, {leaf_rows_cte()}
        SELECT doc_id, array_to_string(list_transform(leaves[1:{P.SEQ_LEN - 2}], lambda x: x.token), chr(31)) AS tokens,
          array_to_string(list_transform(leaves[1:{P.SEQ_LEN - 2}], lambda x: x.depth), ',') AS depths,
          array_to_string(list_transform(leaves[1:{P.SEQ_LEN - 2}], lambda x: x.sib), ',') AS sibs FROM lv"""
    S["wrap"] = f"""{FEAT} SELECT doc_id, {txt('w_ids', 'input_ids')}, {txt('w_dep', 'depths')},
        {txt('w_sib', 'sibling_indices')}, {txt('w_tm', 'tree_attention_mask')} FROM wrapped"""
    S["attention"] = f"{FEAT} SELECT doc_id, {txt('attention_mask')} FROM feats"
    more = P.PAD_LEN - P.SEQ_LEN
    fill = {"input_ids": 0, "attention_mask": 0, "depths": -1, "sibling_indices": -1, "tree_attention_mask": 0}
    S["pad"] = f"""{FEAT} SELECT doc_id, {", ".join(
        f"array_to_string({c} || list_transform(range({more}), lambda x: {v}), ',') AS {c}" for c, v in fill.items())} FROM feats"""
    L = P.SEQ_LEN
    S["check_lengths"] = f"""{FEAT} SELECT doc_id, CAST(len(w_ids) AS INTEGER) AS n_input_ids,
        CAST(len(w_ids) AS INTEGER) AS n_attention_mask, CAST(len(w_dep) AS INTEGER) AS n_depths,
        CAST(len(w_sib) AS INTEGER) AS n_sibling_indices, CAST(len(w_tm) AS INTEGER) AS n_tree_attention_mask
        FROM wrapped WHERE len(w_ids) <> {L} OR len(w_dep) <> {L} OR len(w_sib) <> {L} OR len(w_tm) <> {L}"""
    S["mask_unknown"] = f"""{FEAT} SELECT doc_id, array_to_string(list_transform(range(1, len(input_ids) + 1),
        lambda i: CASE WHEN input_ids[i] = 3 THEN 0 ELSE tree_attention_mask[i] END), ',') AS tree_attention_mask
        FROM feats"""
    pair_cols = ", ".join(f"array_to_string(f{s}.{c}, ',') AS {c}_{s}" for s in (1, 2) for c in
                          ["input_ids", "attention_mask", "depths", "sibling_indices"])
    S["pair_features"] = f"""WITH {docs_cte(False)}, {features_ctes(align=False)},
        um AS (SELECT doc_id, input_ids, attention_mask, depths, sibling_indices,
                 list_transform(range(1, len(input_ids) + 1), lambda i:
                   CASE WHEN input_ids[i] = 3 THEN 0 ELSE tree_attention_mask[i] END) AS tree_attention_mask
               FROM feats),
        pr AS (SELECT a.doc_id AS pair_id, a.doc_id AS d1, b.doc_id AS d2,
                 CAST(a.lang IS NOT DISTINCT FROM b.lang AS INTEGER) AS labels
               FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
        SELECT pr.pair_id, {pair_cols}, array_to_string(f1.tree_attention_mask, ',') AS tree_attention_mask_1,
          array_to_string(f2.tree_attention_mask, ',') AS tree_attention_mask_2, pr.labels
        FROM pr JOIN um f1 ON f1.doc_id = pr.d1 JOIN um f2 ON f2.doc_id = pr.d2"""
    base_cols = ", ".join(f"array_to_string(f{k}.{c}, ',') AS {c}_{k}" for k in (1, 2) for c in ["input_ids", "attention_mask"])
    S["model_columns_pair"] = f"""WITH {docs_cte(False)}, {features_ctes(align=False)}
        SELECT a.doc_id AS pair_id, {base_cols}, CAST(a.lang IS NOT DISTINCT FROM b.lang AS INTEGER) AS labels
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
        JOIN feats f1 ON f1.doc_id = a.doc_id JOIN feats f2 ON f2.doc_id = b.doc_id"""
    S["position_ids"] = f"""{FEAT} SELECT doc_id, array_to_string(list_transform(range(1, len(input_ids) + 1),
        lambda i: {pos_id_expr('input_ids', 'i')}), ',') AS position_ids FROM feats"""
    S["token_types"] = f"""{FEAT} SELECT doc_id, array_to_string(list_transform(input_ids, lambda x: 0), ',')
        AS token_type_ids FROM feats"""
    S["tree_positions"] = f"""{FEAT} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos,
        greatest(depths[i], 0) AS depth_idx, greatest(sibling_indices[i], 0) AS sib_idx,
        CAST(depths[i] <> -1 AS INTEGER) * tree_attention_mask[i] AS depth_on,
        CAST(sibling_indices[i] <> -1 AS INTEGER) * tree_attention_mask[i] AS sib_on
        FROM feats, range(1, {L + 1}) r(i)"""
    S["check_ranges"] = f"""{FEAT} SELECT doc_id, list_max(depths) AS max_depth, list_max(sibling_indices) AS max_sib
        FROM feats WHERE list_max(depths) >= {P.RANGE_MAX_DEPTH} OR list_max(sibling_indices) >= {P.RANGE_MAX_SIB}"""
    S["special_mask"] = f"""{FEAT} SELECT doc_id, array_to_string(list_transform(input_ids,
        lambda x: CASE WHEN x IN (0, 1, 2, 3, 4) THEN 1 ELSE 0 END), ',') AS special_mask FROM feats"""
    u0 = f"({draw_sql('doc_id', 'i - 1')} / {U32})"
    chosen = f"(input_ids[i] NOT IN (0, 1, 2, 3, 4) AND {u0} < {P.MASK_PROB!r})"
    masked_cte = f"""{FEAT}, mk AS (SELECT doc_id,
        list_transform(range(1, len(input_ids) + 1), lambda i: CASE WHEN {chosen} THEN 4 ELSE input_ids[i] END) AS ids,
        list_transform(range(1, len(input_ids) + 1), lambda i: CASE WHEN {chosen} THEN input_ids[i] ELSE -100 END) AS labels
        FROM feats)"""
    S["mask_eval"] = f"{masked_cte} SELECT doc_id, {txt('ids', 'input_ids')}, {txt('labels')} FROM mk"
    S["scored"] = f"""{masked_cte} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ids[i] AS input_id, labels[i] AS label
        FROM mk, range(1, {L + 1}) r(i) WHERE labels[i] <> -100"""
    uk = [f"({draw_sql('doc_id', 'i - 1', slot=k)} / {U32})" for k in range(4)]
    vsz = P.VOCAB_SIZE + 5
    new_id = (f"CASE WHEN NOT {chosen} THEN input_ids[i] WHEN {uk[1]} < 0.8 THEN 4 "
              f"WHEN {uk[2]} < 0.5 THEN CAST(floor({uk[3]} * {vsz}) AS INTEGER) ELSE input_ids[i] END")
    S["mask_train"] = f"""{FEAT} SELECT doc_id,
        array_to_string(list_transform(range(1, len(input_ids) + 1), lambda i: {new_id}), ',') AS input_ids,
        array_to_string(list_transform(range(1, len(input_ids) + 1),
          lambda i: CASE WHEN {chosen} THEN input_ids[i] ELSE -100 END), ',') AS labels FROM feats"""
    srcs = " UNION ALL ".join(f"SELECT doc_id, pos, '{x}' AS source, CAST({x}_id AS INTEGER) AS id, {digest_sql(f'{x}_vec')} AS vec FROM tv"
                              for x in ("word", "type", "position", "depth", "sibling"))
    S["lookup"] = f"{FEAT}, {slots_cte()} {srcs}"
    S["lookup_bucketed"] = f"{FEAT}, {slots_cte()} SELECT doc_id, pos, CAST(word_id AS INTEGER) AS id, {digest_sql('word_vec')} AS vec FROM tv"
    S["fuse_sum"] = fused_sql("sum")
    S["fuse_weighted"] = fused_sql("weighted")
    S["fuse_concat"] = fused_sql("concat")
    S["layer_norm"] = fused_sql("norm")
    S["pair_vector"] = f"""SELECT a.vec_id AS pair_id,
        {num_text_sql('CAST(a.embedding AS DOUBLE[]) || CAST(b.embedding AS DOUBLE[])')} AS pair_vec,
        CAST(a.label = b.label AS INTEGER) AS labels
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
    S["argmax"] = f"WITH {PRED} SELECT vec_id, pred FROM wp"
    S["accuracy"] = f"WITH {PRED} SELECT avg(CAST(pred = label AS DOUBLE)) AS accuracy FROM wp"
    S["class_report"] = f"WITH {PRED} SELECT * FROM rep"
    S["macro"] = f"""WITH {PRED} SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM rep"""
    wavg = ("sum(precision * support) / CAST(sum(support) AS DOUBLE) AS precision, "
            "sum(recall * support) / CAST(sum(support) AS DOUBLE) AS recall, "
            "sum(f1 * support) / CAST(sum(support) AS DOUBLE) AS f1")
    S["weighted"] = f"WITH {PRED} SELECT {wavg} FROM rep"
    S["cross_entropy"] = f"WITH {PRED} SELECT avg(loss) AS loss FROM rl"
    S["batch_ids"] = f"""SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {P.BATCH}) AS BIGINT)
        AS batch FROM embeddings"""
    # masked positions with labels and logits, batches of sequences
    scored = f"""{masked_cte}, sc AS (SELECT doc_id, labels[i] % {P.N_CLASSES} AS label,
          CAST(e.embedding AS DOUBLE[]) AS logits
          FROM mk, range(1, {L + 1}) r(i) JOIN embeddings e ON e.vec_id = (doc_id * {L} + i - 1) % (SELECT count(*) FROM embeddings)
          WHERE labels[i] <> -100),
        tk AS (SELECT doc_id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
          list_max(logits) + ln(list_reduce(list_transform(logits, lambda x: exp(x - list_max(logits))), lambda a, x: a + x, 0.0))
            - logits[label + 1] AS loss FROM sc),
        bt AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {P.BATCH} AS batch FROM mk),
        per AS (SELECT batch, avg(loss) AS m FROM tk JOIN bt USING (doc_id) GROUP BY batch),
        bl8 AS (SELECT sum(m * seqs) / sum(seqs) AS loss FROM per JOIN (SELECT batch, count(*) AS seqs FROM bt GROUP BY batch) USING (batch)),
        cl AS (SELECT c AS cls, (SELECT count(*) FROM tk WHERE label = c) AS support, (SELECT count(*) FROM tk WHERE pred = c) AS predicted,
          (SELECT count(*) FROM tk WHERE label = c AND pred = c) AS tp
          FROM (SELECT label AS c FROM tk UNION SELECT pred FROM tk)),
        rp AS (SELECT support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
          CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM cl)"""
    S["batch_loss"] = f"{scored} SELECT loss FROM bl8"
    acc = "(SELECT avg(CAST(pred = label AS DOUBLE)) FROM tk) AS accuracy"
    S["metric_row"] = f"{scored} SELECT (SELECT loss FROM bl8) AS loss, {acc}, w.* FROM (SELECT {wavg} FROM rp) w"
    S["metric_row_stream"] = S["metric_row"]
    # a Feistel network of six rounds over the two halves of the rank's bits, walked until it gives a rank
    draw = f"(('0x' || substr(md5('{P.SEED}:epoch:' || epoch || ':' || i || ':' || s.r), 1, 8))::BIGINT)"
    net = f"""list_reduce([0, 1, 2, 3, 4, 5], lambda s, i: {{'l': s.r, 'r': xor(s.l, {draw} & ((1::BIGINT << CASE WHEN i % 2 = 0 THEN lb ELSE rb END) - 1))}},
        {{'l': x >> rb, 'r': x & ((1::BIGINT << rb) - 1)}})"""
    places = f"""WITH RECURSIVE n AS (SELECT count(*) AS n, greatest(2, ceil(log2(count(*))))::INTEGER AS bits FROM documents),
      w AS (SELECT n, (bits // 2)::INTEGER AS lb, (bits - bits // 2)::INTEGER AS rb FROM n),
      start AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, n, lb, rb FROM documents, w),
      walk AS (SELECT doc_id, epoch, n, lb, rb, {net} AS y FROM start, range(0, {P.EPOCHS}) e(epoch)
        UNION ALL SELECT doc_id, epoch, n, lb, rb, {net.replace('x >> rb', '((y.l << rb) | y.r) >> rb').replace('x & ', '((y.l << rb) | y.r) & ')} FROM walk
        WHERE ((y.l << rb) | y.r) >= n),
      places AS (SELECT doc_id, epoch::INTEGER AS epoch, ((y.l << rb) | y.r)::BIGINT AS place FROM walk WHERE ((y.l << rb) | y.r) < n)"""
    S["epoch_batches"] = f"{places} SELECT doc_id, epoch, place, place // {P.BATCH} AS batch FROM places"
    S["epoch_batch_rows"] = f"{places} SELECT place, doc_id FROM places WHERE epoch = 1 AND place // {P.BATCH} = 2"
    S["metric_row_macro"] = f"""{scored} SELECT (SELECT loss FROM bl8) AS loss, {acc}, w.*
        FROM (SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM rp) w"""
    S["map_batches"] = """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
        CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents"""
    S["predicate"] = "SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang <> 'en'"
    S["draw"] = f"""SELECT doc_id, {draw_sql('doc_id')} AS draw_int, {draw_sql('doc_id')} / {U32} AS u
        FROM documents"""
