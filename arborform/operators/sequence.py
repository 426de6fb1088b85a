"""Fixed-length feature rows from leaf lists.

The five feature arrays per row, each exactly L long:
  input_ids            start, leaf ids, end, then 0
  attention_mask       1 for start, leaves and end, then 0
  depths               -1, leaf depths, -1, then -1
  sibling_indices      -1, leaf sibling indices, -1, then -1
  tree_attention_mask  0, leaf alignment mask, 0, then 0
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bind, pad
from ..functions.batches import frugal, ship_package_by_value
from .trees import (BLOCK_BYTES, BLOCK_ROWS, WORD_PATTERN, TOKEN_PATTERN, TextLeaves, byte_blocks, layout_lines,
                    layout_places, ranges, whole_text, word_characters)
from .vocab import END_ID, PAD_ID, START_ID, UNK_ID, to_ids, vocab_fits

# The feature format's columns.
FEATURE_COLS = ["input_ids", "attention_mask", "depths", "sibling_indices",
                "tree_attention_mask"]
BASE_COLS = ["input_ids", "attention_mask"]
TREE_COLS = ["depths", "sibling_indices", "tree_attention_mask"]


# ---------------------------------------------------------------- C1
def _aligned(leaves: list, ref: list) -> np.ndarray:
    out = np.zeros(len(leaves), np.int32)
    at = 0
    for token in ref:
        try:
            at = leaves.index(token, at) + 1
        except ValueError:
            return out                      # no later leaf is this token: the pointer stays
        out[at - 1] = 1
    out[at:] = 1                            # the reference is used up
    return out


def aligned(tokens: pa.Array, kept: np.ndarray, ref: pa.Array) -> np.ndarray:
    """C1 over rows: ``tokens`` are all rows' leaf tokens end to end, ``kept`` each
    row's number of them, ``ref`` its list of reference tokens."""
    words = ref.flatten()
    both = pa.concat_arrays([tokens.cast(pa.large_string()), words.cast(pa.large_string())]).dictionary_encode().indices
    codes = pc.fill_null(both, -1).to_numpy(zero_copy_only=False)
    word = codes[len(tokens):]
    n_ref = pc.fill_null(pc.list_value_length(ref), 0).to_numpy(zero_copy_only=False)
    return aligned_codes(codes[:len(tokens)], kept, np.where(word < 0, -2, word), n_ref)    # a null token equals nothing


def aligned_codes(leaf: np.ndarray, kept: np.ndarray, word: np.ndarray, n_ref: np.ndarray) -> np.ndarray:
    """C1 over rows whose leaf and reference tokens are given as codes, end to end, and
    as numbers of each row."""
    leaf, word = leaf.tolist(), word.tolist()
    ends, ref_ends = np.cumsum(kept).tolist(), np.cumsum(n_ref).tolist()
    masks = [_aligned(leaf[a:b], word[c:d]) for a, b, c, d in zip([0] + ends, ends, [0] + ref_ends, ref_ends)]
    return np.concatenate([np.empty(0, np.int32), *masks])


def align_mask(leaves: Column, ref: Column, chunk: int = 64) -> Column:
    """Greedy two-pointer alignment of leaf tokens with reference tokens.

    Walking the leaves in order: a leaf equal to the current reference token
    gets 1 and both pointers move; otherwise the leaf gets 0 and only the
    leaf pointer moves. Once the reference is used up every later leaf keeps 1;
    a reference token that never occurs pins the pointer, so every later leaf
    gets 0. Mask i depends only on leaves 0..i and reference 0..i, so callers
    may slice both arrays to the kept length first.

    Over Arrow batches, ``chunk`` rows at a time: one search per reference token,
    from where the last one ended, so time is linear in the two arrays. Null
    leaves give an empty mask; a null reference is used up from the start.
    """
    ship_package_by_value()

    def run(leaves: pa.Array, ref: pa.Array) -> pa.Array:
        kept = pc.fill_null(pc.list_value_length(leaves), 0).to_numpy(zero_copy_only=False)
        masks = [aligned(leaves[i:i + chunk].flatten(), kept[i:i + chunk], ref[i:i + chunk]) for i in range(0, len(leaves), chunk)]
        ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *masks])))
    return F.arrow_udf(run, "array<int>")(leaves, ref)


# ---------------------------------------------------------------- C2, C5-C8
def truncate(col: Column, length: int) -> Column:
    """Keep the first L-2 entries (room for start and end)."""
    return F.slice(col, 1, length - 2)


def wrap(col: Column, first, last) -> Column:
    """One value before and one after the array."""
    return F.concat(F.array(F.lit(first)), col, F.array(F.lit(last)))


def wrap_all(ids: Column, depths: Column, sibs: Column, tmask: Column,
             start: int = START_ID, end: int = END_ID) -> dict[str, Column]:
    """C5 on the four arrays: start/end ids, -1 depth and sibling, 0 tree mask."""
    return {"input_ids": wrap(ids, start, end), "depths": wrap(depths, -1, -1),
            "sibling_indices": wrap(sibs, -1, -1), "tree_attention_mask": wrap(tmask, 0, 0)}


def attention(ids: Column) -> Column:
    """1 for every real position (specials included)."""
    return F.array_repeat(F.lit(1), F.size(ids))


# Padding per feature column.
PAD_VALUES = {"input_ids": 0, "attention_mask": 0, "depths": -1,
              "sibling_indices": -1, "tree_attention_mask": 0}


def pad_all(cols: dict[str, Column], length: int) -> dict[str, Column]:
    """Right-pad every feature array to L with its padding value."""
    return {k: pad(v, length, PAD_VALUES[k]) for k, v in cols.items()}


def check_lengths(df: DataFrame, length: int, cols=None, strict: bool = False) -> DataFrame:
    """Rows where some feature array is not exactly L long.

    strict=True returns the frame itself with a check that fails the job on
    the first offending row (evaluated lazily with the rest of the plan).
    """
    cols = cols or [c for c in FEATURE_COLS if c in df.columns]
    bad = F.lit(False)
    for c in cols:
        bad = bad | (F.size(c) != length)
    if strict:
        # a filter predicate, so the optimizer cannot prune the check away
        return df.filter(F.when(bad, F.raise_error(
            F.lit(f"feature array length differs from {length}"))).otherwise(F.lit(True)))
    return df.filter(bad)


# ---------------------------------------------------------------- C9 / C11 core
def _kept_rows(staged: DataFrame, key: str, align: bool) -> DataFrame:
    """staged(key, cut, ref) -> one row per kept leaf, with its mask."""
    if align:
        mask = align_mask(F.col("cut.token"), F.col("ref"))
    else:
        mask = F.transform(F.col("cut"), lambda x: F.lit(1))
    # the generator takes the mask expression inline: measured ~3x faster than
    # computing it in a projection and exploding that column in the next step
    return (staged.select(key, F.posexplode(F.arrays_zip(F.col("cut"), mask.alias("mask")))
                          .alias("pos", "z"))
                  .select(key, F.col("pos").cast("int").alias("pos"),
                          F.col("z.cut.token").alias("token"), F.col("z.cut.depth").alias("depth"),
                          F.col("z.cut.sib").alias("sib"), F.col("z.mask").alias("m")))


def _lines(docs: DataFrame, key: str, text_col: str, length: int, align: bool, ref_col: str | None, pattern: str) -> DataFrame:
    """(key, lines, ref): the walk of the whole text, cut to L-2 leaves, and as many
    reference tokens (all that the alignment of kept leaves depends on)."""
    text = F.col(text_col)
    if ref_col is not None:
        ref = _ref(ref_col)
    else:
        ref = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    return docs.select(key, layout_lines(text, pattern, length - 2).alias("lines"), *([truncate(ref, length).alias("ref")] if align else []))


def _ref(ref_col: str) -> Column:
    return F.coalesce(F.col(ref_col), F.array().cast("array<string>"))


def _blocks(batches, align: bool):
    """Keys, leaf tokens (end to end), leaves of each row, depths, sibling indices, masks."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(i, BLOCK_ROWS)
            tokens, depth, sib, kept = layout_places(block.column(1))
            mask = aligned(tokens, kept, block.column(2)) if align else np.ones(len(tokens), np.int32)
            yield block.column(0), tokens, kept, depth, sib, mask


def leaf_rows(docs: DataFrame, key: str, text_col: str, length: int,
              align: bool = True, ref_col: str | None = None,
              pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Walk, cut to L-2 and align, per row; then one row per kept leaf.

    (key, pos, token, depth, sib, m). The walk reads the whole text; only the
    kept leaves (and the kept reference prefix, which is all the alignment of
    kept leaves depends on) leave the row.
    """
    lines = _lines(docs, key, text_col, length, align, ref_col, pattern)
    ship_package_by_value()

    def run(batches):
        for keys, tokens, kept, depth, sib, mask in _blocks(batches, align):
            at = pa.array(np.repeat(np.arange(len(kept)), kept))
            yield pa.RecordBatch.from_arrays([keys.take(at), pa.array(ranges(kept).astype(np.int32)), tokens, *map(pa.array, (depth, sib, mask))],
                                             names=[key, "pos", "token", "depth", "sib", "m"])
    kind = lines.schema[key].dataType.simpleString()
    return lines.mapInArrow(run, f"`{key}` {kind}, pos int, token string, depth int, sib int, m int")


def _coded_blocks(docs: DataFrame, key: str, text_col: str, length: int, align: bool, ref_col: str | None, carry: list[str]) -> DataFrame:
    """Texts, walked and cut to L-2 leaves -> (block, n, code, token, rows): the ``n`` different
    tokens of every block of rows, one each, and, beside the first, what else there is of
    the block's rows: an Arrow stream of key, the lists code, depth, sib, m, and ``carry``.

    The reference is ``ref_col``, else the words of the text; its first L-2 tokens are
    all that the alignment of kept leaves depends on."""
    ship_package_by_value()
    own = align and ref_col is None
    refs = [truncate(_ref(ref_col), length).alias("ref")] if align and not own else []
    texts = docs.select(key, whole_text(F.col(text_col)).alias("text"), *refs, *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    first = 2 + len(refs)
    of_words = word_characters(docs.sparkSession)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, n_rows in byte_blocks(batch.column(1), BLOCK_ROWS, BLOCK_BYTES):
                cols = [c.slice(i, n_rows) for c in batch.columns]
                leaves = TextLeaves(cols[1], of_words)
                keep = ranges(leaves.count) < length - 2
                kept = np.minimum(leaves.count, length - 2)
                words = np.zeros(len(keep), bool)
                if own:
                    row = np.repeat(np.arange(n_rows), leaves.count)
                    n_words = np.bincount(row[leaves.word], minlength=n_rows)
                    words[leaves.word] = ranges(n_words) < length - 2
                either = keep | words
                coded = leaves.tokens(either).dictionary_encode()
                codes = np.empty(len(keep), np.int32)
                codes[either] = coded.indices.to_numpy(zero_copy_only=False)
                code, depth, sib = (x[keep] for x in (codes, leaves.depth, leaves.sib))
                if own:
                    mask = aligned_codes(code, kept, codes[words], np.minimum(n_words, length - 2))
                elif align:
                    mask = aligned(leaves.tokens(keep), kept, cols[2])
                else:
                    mask = np.ones(len(code), np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (code, depth, sib, mask)]
                rows = pa.RecordBatch.from_arrays([cols[0], *lists, *cols[first:]], names=["key", "code", "depth", "sib", "m", *(f"carry_{k}" for k in range(len(carry)))])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                n = len(coded.dictionary)
                data = pa.concat_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(n - 1, pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                                  coded.dictionary, data], names=["block", "n", "code", "token", "rows"])
                block += 1
    return texts.mapInArrow(frugal(run), "block long, n int, code int, token string, rows binary")


def _decoded(coded: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Rows of ``_coded_blocks`` with ids -> key, the lists id, depth, sib, m, and what was
    carried along, a row per key. ``kinds`` are the types of key and carried columns.

    A broadcast join leaves rows in their partition, so a block is put together by
    the task that it is in, in any order of its rows; one that is not whole fails the job.
    """
    def run(batches):
        waiting = {}
        for batch in batches:
            block, n, code, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "n", "code", "id"))
            data = batch.column("rows")
            ends = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
            for a, b in zip(ends[:-1], ends[1:]):
                if a == b:
                    continue
                of, times, rows = waiting.setdefault(block[a], (np.zeros(n[a], np.int32), np.zeros(n[a], np.int32), []))
                of[code[a:b]] = ids[a:b]
                times += np.bincount(code[a:b], minlength=n[a]).astype(np.int32)
                if times.max() > 1:
                    raise ValueError("repeated token in the vocabulary")
                rows += data.slice(a, b - a).drop_null().to_pylist()
                if times.all():
                    del waiting[block[a]]
                    yield _with_ids(rows[0], of)
        if waiting:
            raise RuntimeError("tokens of a block are missing: the rows were moved before they were put together")

    def _with_ids(rows, of):
        got = pa.ipc.open_stream(rows).read_next_batch()
        codes = got.column("code")
        lists = pa.ListArray.from_arrays(codes.offsets, pa.array(of[codes.values.to_numpy()]))
        return pa.RecordBatch.from_arrays([got.column(0), lists, *got.columns[2:]], names=names)
    (key, kind), *carry = kinds.items()
    names = [key, "_id", "_depth", "_sib", "_m", *(c for c, _ in carry)]
    types = [kind, *["array<int>"] * 4, *(k for _, k in carry)]
    return coded.select("block", "n", "code", "id", "rows").mapInArrow(frugal(run), ", ".join(f"`{c}` {k}" for c, k in zip(names, types)))


def one_each(df: DataFrame, key: str) -> DataFrame:
    """``df``, with a check that fails the job on a repeated key."""
    n = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return n.filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(
        F.lit("repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))).drop("_n")


def leaf_rows_of(leaves: DataFrame, key: str, length: int, ref: DataFrame | None = None,
                 align: bool = True, order: str = "leaf_pos") -> DataFrame:
    """The same rows from leaf rows of any walk (B1, B2, B3): (key, order,
    token, depth, sib). The reference is ``ref`` (key, ref array), else the word
    tokens of the leaves themselves.

    The first L-2 leaves of a key are found by a window rank, so a key with very
    many leaves is cut before its leaves are put together.
    """
    w = Window.partitionBy(key).orderBy(order)
    kept = leaves.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= length - 2)
    both = F.sort_array(F.collect_list(F.struct("_n", F.struct(F.coalesce("token", F.lit("")).alias("token"), "depth", "sib").alias("leaf"))))
    staged = kept.groupBy(key).agg(both.alias("s")).select(key, F.transform("s", lambda x: x["leaf"]).alias("cut"))
    if ref is not None:
        staged = staged.join(ref.select(key, truncate(F.col("ref"), length).alias("ref")), key, "left")
        staged = staged.withColumn("ref", F.coalesce("ref", F.array().cast("array<string>")))
    else:
        staged = staged.withColumn("ref", F.flatten(F.transform("cut", lambda x: F.regexp_extract_all(x["token"], F.lit(WORD_PATTERN), F.lit(0)))))
    return _kept_rows(staged.select(key, "cut", "ref"), key, align)


def wrapped_arrays(rows: DataFrame, key: str) -> DataFrame:
    """Leaf rows with ids -> one row per key: C5-wrapped arrays and the C6
    attention mask, not yet padded (one hash shuffle by key)."""
    s = F.sort_array(F.collect_list(F.struct("pos", "id", "depth", "sib", "m")))
    g = rows.groupBy(key).agg(s.alias("s"))
    # places are 0, 1, 2 ...: more leaves than the last place + 1 mean a repeated key
    g = g.filter(F.when(F.size("s") != F.element_at("s", -1)["pos"] + 1, F.raise_error(F.concat(
        F.lit("repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True)))
    wrapped = wrap_all(F.transform("s", lambda x: x["id"]), F.transform("s", lambda x: x["depth"]),
                       F.transform("s", lambda x: x["sib"]), F.transform("s", lambda x: x["m"]))
    wrapped["attention_mask"] = F.array_repeat(F.lit(1), F.size("s") + 2)
    return g.select(key, *[wrapped[c].alias(c) for c in FEATURE_COLS])


def wrapped_features(docs: DataFrame, vocab: DataFrame, key: str, text_col: str, length: int, align: bool = True,
                     ref_col: str | None = None, vocab_rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts -> one row per key: C5-wrapped arrays and the C6 attention mask, not
    yet padded, and the columns ``carry`` of the texts' table.

    Texts are dealt by key (for the check that keys are unique) and walked where
    they lie, over Arrow batches. The vocabulary is joined with the different tokens
    of a block of texts, so neither the join nor an exchange sees a row per leaf. A
    vocabulary over the broadcast bound is joined on leaf rows, which are then put
    together by key.
    """
    rows = vocab.count() if vocab_rows is None else vocab_rows
    if not vocab_fits(rows):
        g = wrapped_arrays(to_ids(leaf_rows(docs, key, text_col, length, align=align, ref_col=ref_col), vocab, bound=rows), key)
        if not carry:
            return g
        # keys are unique; a null one is a key too
        kept = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
        g = g.join(kept, g[key].eqNullSafe(kept["_key"]), "left")
        return g.select(key, *FEATURE_COLS, *[F.col(f"_carry_{c}").alias(c) for c in carry])
    docs = one_each(docs.select(*dict.fromkeys([key, text_col, *([ref_col] if ref_col else []), *carry])), key)
    coded = to_ids(_coded_blocks(docs, key, text_col, length, align, ref_col, list(carry)), vocab, bound=rows)
    g = _decoded(coded, {c: docs.schema[c].dataType.simpleString() for c in (key, *carry)})
    wrapped = wrap_all(F.col("_id"), F.col("_depth"), F.col("_sib"), F.col("_m"))
    wrapped["attention_mask"] = F.array_repeat(F.lit(1), F.size("_id") + 2)
    return g.select(key, *[wrapped[c].alias(c) for c in FEATURE_COLS], *carry)


def padded_features(wrapped: DataFrame, length: int) -> DataFrame:
    """C7 and, strict, C8: arrays of another length fail the job. Further columns
    are carried along."""
    padded = pad_all({c: F.col(c) for c in FEATURE_COLS}, length)
    return check_lengths(wrapped.select(*[padded[c].alias(c) if c in padded else F.col(c) for c in wrapped.columns]), length, strict=True)


def assemble_features(rows: DataFrame, key: str, length: int) -> DataFrame:
    """Leaf rows with ids -> one row per key with the five L-long arrays.

    Strict (C8): arrays of another length fail the job. Two input rows of one
    key would give twice the leaves, so a repeated key fails with a message.
    """
    return padded_features(wrapped_arrays(rows, key), length)


def features(docs: DataFrame, vocab: DataFrame, key: str = "doc_id", text_col: str = "text",
             length: int = 512, ref_col: str | None = None, align: bool = True,
             vocab_rows: int | None = None) -> DataFrame:
    """Feature rows for a table of texts.

    Plan: one hash shuffle of the texts by key -> per-row walk + cut + align ->
    broadcast vocabulary join of each block's tokens -> arrays (``wrapped_features``).
    Every text, a null one included (taken as empty), yields at least one leaf,
    so every input key has an output row. Keys must be unique: a repeated key
    fails the job.
    """
    return padded_features(wrapped_features(docs, vocab, key, text_col, length, align, ref_col, vocab_rows), length)


def features_from_leaves(leaves: DataFrame, vocab: DataFrame, key: str, length: int = 512,
                         ref: DataFrame | None = None, align: bool = True,
                         vocab_rows: int | None = None, order: str = "leaf_pos") -> DataFrame:
    """C9 from the leaf rows of any tree walk, so nested depths and sibling
    indices become features: markup (B1), node tables (B2) or layout (B3)."""
    rows = leaf_rows_of(leaves, key, length, ref=ref, align=align, order=order)
    return assemble_features(to_ids(rows, vocab, bound=vocab_rows), key, length)


def mask_unknown(ids: Column, tmask: Column, unk_id: int = UNK_ID) -> Column:
    """Tree mask 0 wherever the id is the unknown id."""
    return F.zip_with(ids, tmask, lambda i, m: F.when(i == F.lit(unk_id), F.lit(0)).otherwise(m))


# ---------------------------------------------------------------- C12-C15
def position_ids(ids: Column, pad_id: int = PAD_ID) -> Column:
    """(running count of ids != pad) * (id != pad) + pad.

    The running count at i is i + 1 minus the pad ids at or before i. The
    pad positions are found once per row and both arrays are bound as
    lambda arguments, so a row without pad ids costs one pass.
    """
    def with_ids(a):
        pads = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) == F.lit(pad_id))
        return bind(pads, lambda p: F.transform(a, lambda x, i: F.when(
            x == F.lit(pad_id), F.lit(pad_id)).otherwise(
            i + 1 - F.size(F.filter(p, lambda j: j <= i)) + F.lit(pad_id)).cast("int")))
    return F.when(F.size(ids) == 0, F.array().cast("array<int>")).otherwise(bind(ids, with_ids))


def token_types(ids: Column) -> Column:
    """Zeros of the same length."""
    return F.array_repeat(F.lit(0), F.size(ids))


def tree_positions(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """C14: per position the clamped depth / sibling index and the on/off
    factor of each (off where the value is -1 or the tree mask is 0)."""
    z = F.arrays_zip("depths", "sibling_indices", "tree_attention_mask")
    return (df.select(key, F.posexplode(z).alias("pos", "z"))
              .select(key, F.col("pos").cast("int").alias("pos"),
                      F.greatest(F.col("z.depths"), F.lit(0)).alias("depth_idx"),
                      F.greatest(F.col("z.sibling_indices"), F.lit(0)).alias("sib_idx"),
                      ((F.col("z.depths") != -1).cast("int") * F.col("z.tree_attention_mask"))
                      .alias("depth_on"),
                      ((F.col("z.sibling_indices") != -1).cast("int") * F.col("z.tree_attention_mask"))
                      .alias("sib_on")))


def check_ranges(df: DataFrame, max_depth: int, max_sib: int, key: str = "doc_id") -> DataFrame:
    """Rows whose depth or sibling index would overflow the lookup tables."""
    return (df.select(key, F.array_max("depths").alias("max_depth"),
                      F.array_max("sibling_indices").alias("max_sib"))
              .filter((F.col("max_depth") >= max_depth) | (F.col("max_sib") >= max_sib)))
