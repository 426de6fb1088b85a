"""Named queries over the test tables: name -> fn(spark, sf_dir) -> DataFrame.

Each reads the given parquet tables (or frames Spark derives from them) and
runs the operators at full size. Arrays are returned as ','-joined text so
the oracle comparison is unambiguous (see ``plans.oracle``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import int_text, num_md5, num_text, numbers_md5, text_join
from ..functions.batches import map_batches
from ..functions.draw import draw, draw_int
from ..functions.table_functions import LEAF_ARRAYS, LeafArrays, register_walk
from ..operators import masking, metrics, pairs, sequence as seq, splits, vectors
from ..operators.epochs import batch_ranks, epoch_batches
from ..operators.pair_model import fit_pairs, score_pairs
from ..operators.shape import exclude_lang, keep_features, model_columns, split_sizes, unsupported
from ..operators.trees import (TOKEN_PATTERN, WORD_PATTERN, layout_leaf_array, layout_leaves,
                               layout_token_counts, leaf_arrays, markup_leaves, node_leaves, node_order, node_paths)
from ..operators.vocab import build_vocab, build_vocab_frequent, to_ids, vocab_bound
from ..session import fresh_subdir, written
from ..sources.json_splits import read_json_splits, write_json_splits
from ..sources.tables import read_split, read_table, spread, write_features
from ..streaming import metric_stream, stream_metrics
from . import params as P


# ------------------------------------------------------------------ inputs
def doc_keys(spark: SparkSession, d: str, exclude: bool = False) -> DataFrame:
    """documents without the text: scan-pruned, no repartition."""
    df = read_table(spark, d, "documents", ["doc_id", "lang"])
    return exclude_lang(df, P.EXCLUDED_LANG) if exclude else df


def docs(spark: SparkSession, d: str, exclude: bool = False) -> DataFrame:
    df = read_table(spark, d, "documents", ["doc_id", "text", "lang"])
    df = exclude_lang(df, P.EXCLUDED_LANG) if exclude else df
    return spread(df, "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "pages", ["page_id", "html"]), "page_id")


def corpus_tokens(spark: SparkSession, d: str, exclude: bool = False) -> DataFrame:
    return docs(spark, d, exclude).select(
        F.explode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).alias("token"))


def corpus_vocab(spark: SparkSession, d: str, exclude: bool = False) -> DataFrame:
    """C4 over the corpus's leaf tokens. The layout leaves that can enter the
    vocabulary (non-blank ones) are exactly the regex tokens of the whole text
    (a token never spans a line break), so they are counted by blocks of texts
    where these lie, and the counts summed by token."""
    return build_vocab(layout_token_counts(docs(spark, d, exclude), "text"), P.VOCAB_SIZE, times="n")


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    """C9 over documents (one language dropped), arrays kept."""
    src = docs(spark, d, exclude=True)
    vocab = corpus_vocab(spark, d, exclude=True)
    return seq.features(src, vocab, "doc_id", "text", P.SEQ_LEN,
                        vocab_rows=vocab_bound(P.VOCAB_SIZE))


def as_text(df: DataFrame, cols) -> DataFrame:
    return df.select(*[int_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ queries
def q_exclude_lang(spark, d):
    return doc_keys(spark, d, exclude=True).select("doc_id", "lang")


def q_unsupported_lang(spark, d):
    return unsupported(doc_keys(spark, d), P.SUPPORTED_LANGS).select("doc_id", "lang")


def q_layout_leaves(spark, d):
    return layout_leaves(docs(spark, d), "doc_id", "text")


def q_vocab(spark, d):
    return corpus_vocab(spark, d)


def q_vocab_frequent(spark, d):
    """C4 from frequent-token summaries: the rows of ``vocab``."""
    return build_vocab_frequent(corpus_tokens(spark, d), P.VOCAB_SIZE)


def q_token_ids(spark, d):
    leaves = layout_leaves(docs(spark, d), "doc_id", "text")
    return to_ids(leaves, corpus_vocab(spark, d), bound=vocab_bound(P.VOCAB_SIZE)) \
        .select("doc_id", "leaf_pos", "token", "id")


def q_align_mask(spark, d):
    t = F.col("text")
    df = docs(spark, d).select(
        "doc_id",
        F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), F.lit(0)).alias("lt"),
        F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0)).alias("ref"))
    # generator over the inline fold (faster than exploding a projected column)
    return df.select("doc_id", F.posexplode(seq.align_mask(F.col("lt"), F.col("ref")))
                     .alias("pos", "mask")) \
             .select("doc_id", F.col("pos").cast("int").alias("pos"), "mask")


def leaf_vocab(leaves):
    return build_vocab(leaves.select("token"), P.VOCAB_SIZE)


def q_markup_features(spark, d):
    """C9 over nested pages (B1): the reference column holds the page's words."""
    src = pages(spark, d)
    leaves = written(markup_leaves(src, "page_id", "html"), "leaves")
    words = leaves.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("leaf_pos", "token"))).alias("s")).select(
        "page_id", F.flatten(F.transform("s", lambda x: F.regexp_extract_all(x["token"], F.lit(WORD_PATTERN), F.lit(0)))).alias("ref"))
    f = seq.features_from_leaves(leaves, leaf_vocab(leaves), "page_id", P.SEQ_LEN, ref=words, vocab_rows=vocab_bound(P.VOCAB_SIZE))
    return as_text(f, seq.FEATURE_COLS)


def q_node_features(spark, d):
    """C9 over the node table (B2): one row per root, leaves in pre-order."""
    n = written(node_leaves(node_table(spark, d)).select("root_id", "leaf_pos", F.col("text").alias("token"), "depth", "sib"), "leaves")
    f = seq.features_from_leaves(n, leaf_vocab(n), "root_id", P.SEQ_LEN, vocab_rows=vocab_bound(P.VOCAB_SIZE), order="leaf_pos")
    return as_text(f, seq.FEATURE_COLS)


def q_features_ref(spark, d):
    """C9 with a reference-token column of its own: the text's first half."""
    src = docs(spark, d, exclude=True).withColumn("code_tokens", F.regexp_extract_all(
        F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")), F.lit(WORD_PATTERN), F.lit(0)))
    f = seq.features(src, corpus_vocab(spark, d, exclude=True), "doc_id", "text", P.SEQ_LEN, ref_col="code_tokens",
                     vocab_rows=vocab_bound(P.VOCAB_SIZE))
    return as_text(f, seq.FEATURE_COLS)


def q_features(spark, d):
    return as_text(feature_frame(spark, d), seq.FEATURE_COLS)


def wrapped_frame(spark, d):
    src = docs(spark, d, exclude=True)
    vocab = corpus_vocab(spark, d, exclude=True)
    return seq.wrapped_features(src, vocab, "doc_id", "text", P.SEQ_LEN, vocab_rows=vocab_bound(P.VOCAB_SIZE))


def q_source_split(spark, d):
    """A1: docs written as a split table, one split read back (pruned)."""
    labelled = splits.assign_split(doc_keys(spark, d), "doc_id", P.SEED).select("doc_id", "lang", "split")
    path = fresh_subdir(spark, "split_source")
    write_features(labelled, path)
    return read_split(spark, path, "validation").select("doc_id", "lang", "split")


def q_json_split(spark, d):
    """A1 from gzipped JSON lines in split folders: one split, one language left out."""
    rows = splits.assign_split(read_table(spark, d, "documents", ["doc_id", "text", "lang"]), "doc_id", P.SEED)
    path = write_json_splits(rows, fresh_subdir(spark, "json-splits"))
    df = exclude_lang(read_json_splits(spark, path, "doc_id bigint, text string, lang string", "validation"), P.EXCLUDED_LANG)
    return df.select("doc_id", "lang", "split", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_split_sizes(spark, d):
    return split_sizes(splits.assign_split(doc_keys(spark, d), "doc_id", P.SEED))


def source_frame(spark, d):
    """Feature rows of all languages that still carry their source columns. Rows
    without a key are left out."""
    w = seq.wrapped_features(docs(spark, d), corpus_vocab(spark, d), "doc_id", "text", P.SEQ_LEN, vocab_rows=vocab_bound(P.VOCAB_SIZE),
                             carry=("text", "lang"))
    return seq.padded_features(w.filter(F.col("doc_id").isNotNull()), P.SEQ_LEN)


def q_keep_features(spark, d):
    """A4: text and lang go, the derived columns stay."""
    return as_text(keep_features(source_frame(spark, d), "doc_id"), seq.FEATURE_COLS)


def q_model_columns_base(spark, d):
    return as_text(model_columns(source_frame(spark, d), "doc_id", tree=False), seq.FEATURE_COLS)


def q_model_columns_tree(spark, d):
    """A5 with the tree switch on: all five columns of every document."""
    return as_text(model_columns(source_frame(spark, d), "doc_id", tree=True), seq.FEATURE_COLS)


def q_feature_sink(spark, d):
    """Features with split labels written partitioned by split, read back."""
    f = splits.assign_split(feature_frame(spark, d), "doc_id", P.SEED)
    path = fresh_subdir(spark, "features")
    write_features(f, path)
    return as_text(read_split(spark, path), seq.FEATURE_COLS) \
        .select("doc_id", "split", *seq.FEATURE_COLS)


def q_half_split(spark, d):
    return splits.half_split(doc_keys(spark, d).select("doc_id"), "doc_id", P.SEED)


def q_first_n(spark, d):
    valid = splits.half_split(doc_keys(spark, d).select("doc_id"), "doc_id", P.SEED) \
                  .filter(F.col("part") == "valid").drop("part")
    return splits.first_n(valid, "doc_id", P.SEED, P.VALID_CUT)


def q_assemble(spark, d):
    labelled = splits.assign_split(doc_keys(spark, d).select("doc_id"), "doc_id", P.SEED)
    train = labelled.filter(F.col("split") == "train").select("doc_id")
    rest = labelled.filter(F.col("split") != "train").select("doc_id")
    halves = splits.half_split(rest, "doc_id", P.SEED)
    valid = halves.filter(F.col("part") == "valid").select("doc_id")
    test = halves.filter(F.col("part") == "test").select("doc_id")
    return splits.assemble({"train": train, "valid": valid, "test": test})


def q_markup_leaves(spark, d):
    return markup_leaves(pages(spark, d), "page_id", "html")


def node_table(spark, d):
    """region -> nation -> customer -> orders as one parent-pointer table."""
    r = read_table(spark, d, "region").select(
        (F.col("r_regionkey").cast("bigint") * 4).alias("node_id"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.col("r_regionkey").cast("bigint").alias("ord"), F.col("r_name").alias("text"))
    n = read_table(spark, d, "nation").select(
        (F.col("n_nationkey").cast("bigint") * 4 + 1).alias("node_id"),
        (F.col("n_regionkey").cast("bigint") * 4).alias("parent_id"),
        F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("text"))
    c = read_table(spark, d, "customer").select(
        (F.col("c_custkey") * 4 + 2).alias("node_id"),
        (F.col("c_nationkey").cast("bigint") * 4 + 1).alias("parent_id"),
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("text"))
    o = read_table(spark, d, "orders").select(
        (F.col("o_orderkey") * 4 + 3).alias("node_id"),
        (F.col("o_custkey") * 4 + 2).alias("parent_id"),
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"))
    return r.unionByName(n).unionByName(c).unionByName(o)


def q_node_leaves(spark, d):
    return node_leaves(node_table(spark, d))


def q_node_order(spark, d):
    """B2 for every node: pre-order, depth, sibling index, place among the leaves."""
    return node_order(node_table(spark, d))


def q_node_paths(spark, d):
    """Leaves with the path of ords from their root."""
    nodes = node_table(spark, d)
    out = node_paths(nodes).join(node_leaves(nodes).select("node_id", "sib", "text"), "node_id")
    return out.select("node_id", "root_id", "depth", "sib", int_text(F.col("path")).alias("path"), "text")


def q_leaf_arrays(spark, d):
    la = leaf_arrays(layout_leaves(docs(spark, d), "doc_id", "text"), "doc_id")
    return la.select("doc_id", text_join(F.col("tokens")).alias("tokens"),
                     int_text(F.col("tree_mask")).alias("tree_mask"),
                     int_text(F.col("depths")).alias("depths"), int_text(F.col("sibs")).alias("sibs"))


def q_leaf_arrays_walk(spark, d):
    """B4 by a walk over ordered rows, called from SQL as a table function."""
    register_walk(spark, "walk_leaves", LeafArrays, LEAF_ARRAYS)
    layout_leaves(docs(spark, d), "doc_id", "text").createOrReplaceTempView("leaves_to_walk")
    la = spark.sql("SELECT * FROM walk_leaves(TABLE(leaves_to_walk) PARTITION BY doc_id ORDER BY leaf_pos)")
    return la.select("doc_id", text_join(F.col("tokens")).alias("tokens"), int_text(F.col("tree_mask")).alias("tree_mask"),
                     int_text(F.col("depths")).alias("depths"), int_text(F.col("sibs")).alias("sibs"))


def q_truncate(spark, d):
    cut = seq.truncate(layout_leaf_array(F.col("text")), P.SEQ_LEN)
    t = docs(spark, d, exclude=True).select("doc_id", cut.alias("c"))
    return t.select("doc_id", text_join(F.col("c.token")).alias("tokens"),
                    int_text(F.col("c.depth")).alias("depths"), int_text(F.col("c.sib")).alias("sibs"))


def q_wrap(spark, d):
    w = wrapped_frame(spark, d)
    return as_text(w.select("doc_id", "input_ids", "depths", "sibling_indices", "tree_attention_mask"),
                   seq.FEATURE_COLS)


def q_attention(spark, d):
    return as_text(feature_frame(spark, d).select("doc_id", "attention_mask"), seq.FEATURE_COLS)


def q_pad(spark, d):
    w = wrapped_frame(spark, d)
    padded = seq.pad_all({c: F.col(c) for c in seq.FEATURE_COLS}, P.PAD_LEN)
    return as_text(w.select("doc_id", *[padded[c].alias(c) for c in seq.FEATURE_COLS]),
                   seq.FEATURE_COLS)


def q_check_lengths(spark, d):
    off = seq.check_lengths(wrapped_frame(spark, d), P.SEQ_LEN)
    return off.select("doc_id", *[F.size(c).alias(f"n_{c}") for c in seq.FEATURE_COLS])


def q_mask_unknown(spark, d):
    f = feature_frame(spark, d)
    return f.select("doc_id", int_text(seq.mask_unknown(F.col("input_ids"), F.col("tree_attention_mask")))
                    .alias("tree_attention_mask"))


def pair_frame(spark, d):
    """Adjacent documents as pairs: hashes first, texts only to be featurised."""
    src = read_table(spark, d, "documents", ["doc_id", "text", "lang"])
    hashed = written(src.select("doc_id", pairs.text_hash(F.col("text")).alias("h"), "lang"), "pair-hashes")
    texts = src.select(pairs.text_hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return pairs.pair_features_of(pairs.adjacent_pairs(hashed, "doc_id", "lang"), texts, corpus_vocab(spark, d),
                                  P.SEQ_LEN, vocab_rows=vocab_bound(P.VOCAB_SIZE))


def q_pair_features(spark, d):
    pf = pair_frame(spark, d)
    return as_text(pf, [c for c in pf.columns if c not in ("pair_id", "labels")])


def q_model_columns_pair(spark, d):
    """A5 on pairs, base columns only."""
    m = model_columns(pair_frame(spark, d), "pair_id", tree=False, pair=True)
    return as_text(m, [c for c in m.columns if c not in ("pair_id", "labels")])


def q_position_ids(spark, d):
    f = feature_frame(spark, d)
    return f.select("doc_id", int_text(seq.position_ids(F.col("input_ids"))).alias("position_ids"))


def q_token_types(spark, d):
    f = feature_frame(spark, d)
    return f.select("doc_id", int_text(seq.token_types(F.col("input_ids"))).alias("token_type_ids"))


def q_tree_positions(spark, d):
    return seq.tree_positions(feature_frame(spark, d), "doc_id")


def q_check_ranges(spark, d):
    return seq.check_ranges(feature_frame(spark, d), P.RANGE_MAX_DEPTH, P.RANGE_MAX_SIB)


def q_special_mask(spark, d):
    f = feature_frame(spark, d)
    return f.select("doc_id", int_text(masking.special_mask(F.col("input_ids"))).alias("special_mask"))


def masked_eval(spark, d):
    f = feature_frame(spark, d).select("doc_id", "input_ids")
    return masking.mask_tokens(f, "doc_id", P.MASK_PROB, P.SEED)


def q_mask_eval(spark, d):
    return as_text(masked_eval(spark, d), ["input_ids", "labels"])


def q_mask_train(spark, d):
    f = feature_frame(spark, d).select("doc_id", "input_ids")
    m = masking.mask_tokens_train(f, "doc_id", P.MASK_PROB, P.SEED, vocab_bound(P.VOCAB_SIZE))
    return as_text(m, ["input_ids", "labels"])


def q_scored(spark, d):
    return masking.scored(masked_eval(spark, d), "doc_id")


# ---------------------------------------------------------------- vectors
def slot_arrays(spark, d):
    """What ``token_slots`` is made of, with a row per feature row."""
    ids = F.col("input_ids")
    return feature_frame(spark, d).select("doc_id", ids.alias("word_id"), seq.token_types(ids).alias("type_id"),
                                          seq.position_ids(ids).alias("position_id"), *seq.TREE_COLS)


def token_slots(spark, d, f=None):
    """(doc_id, pos, ids per source, on/off factors) for every position of the
    feature rows ``f``, by default those of the documents."""
    f = feature_frame(spark, d) if f is None else f
    # the generator takes the derived arrays inline (see leaf_rows)
    ids = F.col("input_ids")
    z = F.arrays_zip(ids.alias("w"), seq.token_types(ids).alias("y"), seq.position_ids(ids).alias("p"),
                     F.col("depths").alias("d"), F.col("sibling_indices").alias("s"),
                     F.col("tree_attention_mask").alias("t"))
    rows = f.select("doc_id", F.posexplode(z).alias("pos", "z"))
    return rows.select(
        "doc_id", F.col("pos").cast("int").alias("pos"),
        F.col("z.w").alias("word_id"), F.col("z.y").alias("type_id"), F.col("z.p").alias("position_id"),
        *vectors.slot_columns(F.col("z.d"), F.col("z.s"), F.col("z.t")))


def vector_table(spark, d, source: str):
    """The table of one source: ids 0 .. rows - 1, each with a vector of the
    embeddings table (as if learnt for that source)."""
    e = read_table(spark, d, "embeddings", ["vec_id", "embedding"])
    n = e.count()
    ids = spark.range(P.VEC_ROWS[source]).select(
        F.col("id").cast("int").alias("id"), ((F.col("id") + P.VEC_OFFSETS[source]) % n).alias("vec_id"))
    return ids.join(e, "vec_id").select("id", "embedding")


def _lookup(rows, spark, d, source, of=None):
    return vectors.lookup(rows, vector_table(spark, d, source), f"{source}_id", f"{source}_vec",
                          table_id="id", bound=P.VEC_ROWS[source], dim=P.VEC_DIM, of=of)


def token_vectors(spark, d, of=None):
    rows = token_slots(spark, d)
    for src in vectors.SOURCES:
        rows = _lookup(rows, spark, d, src, of)
    return rows


def vec_digest(v):
    """A vector as the md5 of its values as text: results stay small over all positions."""
    return num_md5(v)


def _fused(spark, d, how):
    tables = {s: vector_table(spark, d, s) for s in vectors.SOURCES}
    return vectors.fused(slot_arrays(spark, d), tables, P.VEC_ROWS, P.VEC_DIM, "sum" if how == "norm" else how, "vec",
                         weights=P.FUSE_WEIGHTS, eps=P.LN_EPS if how == "norm" else None, of=numbers_md5(), kind="string", pos_col="pos")


def q_lookup(spark, d):
    t = token_vectors(spark, d, of=vec_digest)
    srcs = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_id").alias("id"),
                                        F.col(f"{s}_vec").alias("vec")) for s in vectors.SOURCES])).alias("x")
    return t.select("doc_id", "pos", srcs).select("doc_id", "pos", "x.source", "x.id", "x.vec")


def q_lookup_bucketed(spark, d):
    """E1 of the word vectors from a table bucketed by id."""
    name = "vectors_" + uuid.uuid4().hex
    vectors.bucket_table(vector_table(spark, d, "word"), name, P.BUCKETS, fresh_subdir(spark, "buckets"), table_id="id")
    # the rows are read three times: the feature rows are written once
    slots = token_slots(spark, d, written(feature_frame(spark, d), "features"))
    t = vectors.lookup_bucketed(slots.select("doc_id", "pos", "word_id"), name, "word_id", "vec", P.BUCKETS, of=vec_digest)
    return t.select("doc_id", "pos", F.col("word_id").alias("id"), "vec")


def q_fuse_sum(spark, d):
    return _fused(spark, d, "sum")


def q_fuse_weighted(spark, d):
    return _fused(spark, d, "weighted")


def q_fuse_concat(spark, d):
    return _fused(spark, d, "concat")


def q_layer_norm(spark, d):
    return _fused(spark, d, "norm")


def emb_pairs(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    side = lambda key, name: e.select(key.alias("pair_id"), F.lit(0).alias("pos"),
                                      F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias(name))
    pv = pairs.pair_vector(side(F.col("vec_id"), "l1"), side(F.col("vec_id") - 1, "l2"))
    return pv.select("pair_id", "pair_vec", (F.col("l1") == F.col("l2")).cast("int").alias("labels"))


def q_pair_vector(spark, d):
    return emb_pairs(spark, d).select("pair_id", num_text(F.col("pair_vec")).alias("pair_vec"), "labels")


def document_vectors(spark, d):
    """(doc_id, lang, vec): shares of a document's vocabulary ids by id modulo
    the vector's width, over all kept positions. Stands in for a model's
    first-position vector of a text."""
    f = source_frame(spark, d).select("doc_id", "lang", vectors.id_shares(F.col("input_ids"), P.DOC_DIM, 4).alias("vec"))
    return f.filter(F.col("vec").isNotNull())


def doc_pairs(spark, d):
    """Pairs (document i, document i + 1); similar = same language."""
    v = written(document_vectors(spark, d), "doc-vectors")
    side = lambda key, name: v.select(key.alias("pair_id"), F.lit(0).alias("pos"), "vec", F.col("lang").alias(name))
    pv = pairs.pair_vector(side(F.col("doc_id"), "l1"), side(F.col("doc_id") - 1, "l2"))
    return pv.select("pair_id", "pair_vec", F.col("l1").eqNullSafe(F.col("l2")).cast("int").alias("labels"))


def pair_scores(spark, d):
    """E7 held out: fitted on the train part, the epoch chosen on the validation
    part, scored on the test part."""
    data = written(splits.assign_split(doc_pairs(spark, d), "pair_id", P.SEED), "pairs")
    part = lambda name: data.filter(F.col("split") == name)
    return score_pairs(fit_pairs(part("train"), part("validation"), seed=P.SEED), part("test"))


def q_pair_classify(spark, d):
    """Predicted class and class scores of the test pairs (a fitted model: no SQL)."""
    return pair_scores(spark, d).select("pair_id", "labels", "prediction", num_text(F.col("scores")).alias("scores"))


def q_pair_macro(spark, d):
    """Macro averages over the test pairs (a fitted model: no SQL)."""
    return metrics.macro(metrics.class_report(pair_scores(spark, d), "labels", "prediction"))


# ---------------------------------------------------------------- evaluation
def predictions(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", F.slice("embedding", 1, P.N_CLASSES).cast("array<double>").alias("logits"),
                    F.col("label").cast("int").alias("label"))


def with_pred(spark, d):
    return predictions(spark, d).withColumn("pred", metrics.argmax(F.col("logits")))


def q_argmax(spark, d):
    return with_pred(spark, d).select("vec_id", "pred")


def q_accuracy(spark, d):
    return metrics.accuracy(with_pred(spark, d))


def q_class_report(spark, d):
    return metrics.class_report(with_pred(spark, d))


def q_macro(spark, d):
    return metrics.macro(metrics.class_report(with_pred(spark, d)))


def q_weighted(spark, d):
    return metrics.weighted(metrics.class_report(with_pred(spark, d)))


def q_cross_entropy(spark, d):
    return metrics.cross_entropy(predictions(spark, d))


def q_batch_ids(spark, d):
    return metrics.batch_ids(predictions(spark, d).select("vec_id"), "vec_id", P.BATCH) \
        .select("vec_id", "batch")


def masked_positions(spark, d):
    """Masked evaluation end to end: every position of the masked feature rows
    (D2) with its label, -100 where it was not masked, else the class of the id
    taken away, and the row of the embeddings table that has its logits."""
    m = masked_eval(spark, d)
    z = F.arrays_zip(F.col("input_ids").alias("x"), F.col("labels").alias("y"))
    pos = m.select("doc_id", F.posexplode(z).alias("pos", "z")).select(
        "doc_id", "pos", F.when(F.col("z.y") == metrics.IGNORE, F.lit(metrics.IGNORE)).otherwise(
            F.col("z.y") % P.N_CLASSES).alias("label"))
    return pos.withColumn("vid", (F.col("doc_id") * P.SEQ_LEN + F.col("pos")) % vector_rows(spark, d).count())


def vector_rows(spark, d):
    return read_table(spark, d, "embeddings", ["vec_id", "embedding"])


def predicted(rows, spark, d):
    """``rows`` of masked positions, which may be a stream, with their logits."""
    e = vector_rows(spark, d)
    return vectors.lookup(rows, e, "vid", "logits", bound=e.count(), dim=P.VEC_DIM)


def masked_predictions(spark, d):
    """``masked_positions`` with the logits: a vector of the embeddings table."""
    return predicted(masked_positions(spark, d), spark, d)


def q_batch_loss(spark, d):
    return metrics.batch_loss(masked_predictions(spark, d), "doc_id", P.BATCH, seqs=doc_keys(spark, d, exclude=True))


def q_metric_row(spark, d):
    return metrics.evaluate(masked_predictions(spark, d), "doc_id", P.BATCH, "weighted",
                            seqs=doc_keys(spark, d, exclude=True))


def q_metric_row_macro(spark, d):
    return metrics.evaluate(masked_predictions(spark, d), "doc_id", P.BATCH, "macro",
                            seqs=doc_keys(spark, d, exclude=True))


def q_epoch_batches(spark, d):
    """Place and batch of every document in each of P.EPOCHS epochs."""
    return epoch_batches(doc_keys(spark, d), "doc_id", P.SEED, P.EPOCHS, P.BATCH)


def q_epoch_batch_rows(spark, d):
    """The documents of one batch of the second epoch, found from its places."""
    keys = doc_keys(spark, d).select("doc_id")
    ranked = splits.global_rank(keys, "doc_id")
    return batch_ranks(spark, keys.count(), P.SEED, 1, 2, P.BATCH).join(ranked, "rank").select("place", "doc_id")


FILE_SEQS = 8_000        # sequences that P.STREAM_FILES files of the stream hold, at most


def q_metric_row_stream(spark, d):
    """F9 over the same positions as ``metric_row``, arriving as a file stream.

    The files have the position and the place of its logits; a micro-batch looks
    the logits of its own rows up, so no more of them than that exist at a time and
    none are written or dealt."""
    keys = doc_keys(spark, d, exclude=True).select("doc_id")
    order = metrics.batch_ids(keys, "doc_id", P.BATCH).select("doc_id", "batch")
    rows = masked_positions(spark, d).filter((F.col("label") != metrics.IGNORE) | (F.col("pos") == 0)).join(order, "doc_id")
    rows = rows.select("batch", F.col("doc_id").alias("seq"), F.timestamp_seconds(F.lit(86_400)).alias("ts"), "vid", "label")
    src, out = fresh_subdir(spark, "stream-in"), fresh_subdir(spark, "stream-out")
    # more files for more sequences: a file's rows pass through one task
    files = P.STREAM_FILES * max(1, -(-keys.count() // FILE_SEQS))
    rows.repartition(files, "seq").write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(src)
    stream = predicted(stream, spark, d).select("batch", "seq", "ts", "logits", "label")
    q = metric_stream(stream, out, fresh_subdir(spark, "stream-state"))
    q.processAllAvailable()
    q.stop()
    return stream_metrics(spark, out)


# ---------------------------------------------------------------- user functions
def _doc_stats(batch, sep="\n"):
    import pandas as pd
    t = batch["text"].fillna("")
    return pd.DataFrame({"doc_id": batch["doc_id"], "n_chars": t.str.len().astype("int64"),
                         "n_lines": (t.str.count(sep) + 1).astype("int64")})


def q_map_batches(spark, d):
    return map_batches(docs(spark, d).select("doc_id", "text"), _doc_stats,
                       "doc_id long, n_chars long, n_lines long", sep="\n")


def q_predicate(spark, d):
    df = read_table(spark, d, "documents", ["doc_id", "n_chars", "lang"])
    return df.filter((F.col("n_chars") > 1000) & (F.col("lang") != "en")).select("doc_id")


def q_draw(spark, d):
    return doc_keys(spark, d).select("doc_id", draw_int(P.SEED, F.col("doc_id")).alias("draw_int"),
                                 draw(P.SEED, F.col("doc_id")).alias("u"))


QUERIES = {
    # A: sources, sinks, shape
    "source_split": q_source_split,
    "json_split": q_json_split,
    "split_sizes": q_split_sizes,
    "exclude_lang": q_exclude_lang,
    "unsupported_lang": q_unsupported_lang,
    "keep_features": q_keep_features,
    "model_columns_base": q_model_columns_base,
    "model_columns_tree": q_model_columns_tree,
    "model_columns_pair": q_model_columns_pair,
    "feature_sink": q_feature_sink,
    "half_split": q_half_split,
    "first_n": q_first_n,
    "assemble": q_assemble,
    # B: tree walks
    "markup_leaves": q_markup_leaves,
    "node_leaves": q_node_leaves,
    "node_order": q_node_order,
    "node_paths": q_node_paths,
    "layout_leaves": q_layout_leaves,
    "leaf_arrays": q_leaf_arrays,
    "leaf_arrays_walk": q_leaf_arrays_walk,
    # C: sequence features
    "vocab": q_vocab,
    "vocab_frequent": q_vocab_frequent,
    "token_ids": q_token_ids,
    "align_mask": q_align_mask,
    "truncate": q_truncate,
    "wrap": q_wrap,
    "attention": q_attention,
    "pad": q_pad,
    "check_lengths": q_check_lengths,
    "features": q_features,
    "features_ref": q_features_ref,
    "markup_features": q_markup_features,
    "node_features": q_node_features,
    "mask_unknown": q_mask_unknown,
    "pair_features": q_pair_features,
    "position_ids": q_position_ids,
    "token_types": q_token_types,
    "tree_positions": q_tree_positions,
    "check_ranges": q_check_ranges,
    # D: masking
    "special_mask": q_special_mask,
    "mask_eval": q_mask_eval,
    "mask_train": q_mask_train,
    "scored": q_scored,
    # E: vectors
    "lookup": q_lookup,
    "lookup_bucketed": q_lookup_bucketed,
    "fuse_sum": q_fuse_sum,
    "fuse_weighted": q_fuse_weighted,
    "fuse_concat": q_fuse_concat,
    "layer_norm": q_layer_norm,
    "pair_vector": q_pair_vector,
    "pair_classify": q_pair_classify,
    "pair_macro": q_pair_macro,
    # F: evaluation
    "argmax": q_argmax,
    "accuracy": q_accuracy,
    "class_report": q_class_report,
    "macro": q_macro,
    "weighted": q_weighted,
    "cross_entropy": q_cross_entropy,
    "batch_ids": q_batch_ids,
    "batch_loss": q_batch_loss,
    "metric_row": q_metric_row,
    "metric_row_macro": q_metric_row_macro,
    "metric_row_stream": q_metric_row_stream,
    "epoch_batches": q_epoch_batches,
    "epoch_batch_rows": q_epoch_batch_rows,
    # G: user functions
    "map_batches": q_map_batches,
    "predicate": q_predicate,
    "draw": q_draw,
}
