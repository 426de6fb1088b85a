"""Leaf walks over trees, giving each leaf its depth and sibling index.

Conventions (kept from the feature format):
  * the root is depth 0 and sibling 0; a node's sibling index counts all
    children of its parent from 0, leaves or not;
  * a node without children is a leaf, so a one-node tree has one leaf at
    depth 0;
  * leaves are listed in document (pre-order) order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import bind
from ..functions.batches import frugal, ship_package_by_value
from ..session import written
from .listrank import BASE, list_rank
from .markup import BLANK_CHARS, MARKUP_PATTERN, NEST_TAGS, RAW_PATTERN, TAG_NAME_PATTERN, markup_walk  # noqa: F401

# Token patterns (Java and RE2 read them the same way).
# A token is a run of letters, digits and '_' or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
SPACE_BYTES = b" \t\n\r\f\x0b"     # in no token

BLOCK_ROWS = 2000        # rows of an Arrow batch that are worked on at once
BLOCK_BYTES = 16 << 20   # and their bytes of text, unless one text has more


# --------------------------------------------------------------------------
# Layout tree  text -> lines -> tokens
# --------------------------------------------------------------------------

def layout_leaf_array(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Per-row leaf list of the layout tree, in document order.

    Root = the text; children = its lines (split on '\\n'); grandchildren =
    the regex tokens of a line. A token is a leaf at depth 2 whose sibling
    index is its place in the line; a line without tokens is a leaf at
    depth 1 (sibling = line index); an empty text is a single leaf at depth 0,
    and a null text is taken as empty, so every row has a leaf.
    Built with array functions only: no shuffle, one pass per row.
    """
    text = F.coalesce(text, F.lit(""))
    # A line's tokens are bound once, and its lambda reads only its own
    # arguments (no outer expression re-evaluated per element).

    def per_line(ln, i):
        def leaves(toks):
            line_leaf = F.array(F.struct(ln.alias("token"), F.lit(1).alias("depth"), i.alias("sib")))
            tok_leaves = F.transform(toks, lambda x, j: F.struct(x.alias("token"), F.lit(2).alias("depth"),
                                                                 j.alias("sib")))
            return F.when(F.size(toks) == 0, line_leaf).otherwise(tok_leaves)
        return bind(F.regexp_extract_all(ln, F.lit(pattern), F.lit(0)), leaves)

    # no cast of the leaves: it would copy every one of them
    root_leaf = F.array(F.struct(text.alias("token"), F.lit(0).alias("depth"), F.lit(0).alias("sib")))
    return F.when(text == F.lit(""), root_leaf).otherwise(F.flatten(F.transform(F.split(text, "\n"), per_line)))


def layout_lines(text: Column, pattern: str = TOKEN_PATTERN, keep: int | None = None) -> Column:
    """The leaf tokens of the layout tree and where its lines end: a struct of
    ``tokens`` (the first ``keep`` leaves' tokens, or all) and ``sizes`` (every
    line's number of regex tokens; a line without any is one leaf, itself).
    ``layout_places`` makes depths and sibling indices of it."""
    def per_line(ln):
        return bind(F.regexp_extract_all(ln, F.lit(pattern), F.lit(0)), lambda toks: F.struct(
            F.when(F.size(toks) == 0, F.array(ln)).otherwise(toks).alias("t"), F.size(toks).alias("n")))

    def both(per):
        tokens = F.flatten(F.transform(per, lambda p: p["t"]))
        return F.struct((tokens if keep is None else F.slice(tokens, 1, keep)).alias("tokens"),
                        F.transform(per, lambda p: p["n"]).alias("sizes"))
    return bind(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), per_line), both)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of ``counts``, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def layout_places(lines: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``layout_lines`` -> of all rows' leaves, end to end: token, depth,
    sibling index; and the number of leaves of each row."""
    tokens, sizes = lines.field("tokens"), lines.field("sizes")
    kept = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    n_lines = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
    flat, n = tokens.flatten(), sizes.flatten().to_numpy(zero_copy_only=False)
    leaves = np.maximum(n, 1)                       # of a line
    line_row = np.repeat(np.arange(len(kept)), n_lines)
    all_leaves = np.bincount(line_row, leaves, len(kept)).astype(np.int64)
    in_keep = ranges(all_leaves) < np.repeat(kept, all_leaves)
    blank = np.repeat(n == 0, leaves)[in_keep]
    depth = np.where(blank, 1, 2)
    sib = np.where(blank, np.repeat(ranges(n_lines), leaves)[in_keep], ranges(leaves)[in_keep])
    # one line and it is empty: the text is empty, its root is the leaf
    root = blank & np.repeat(n_lines == 1, kept)
    if root.any():
        depth[root & (pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0)] = 0
    return flat, depth.astype(np.int32), sib.astype(np.int32), kept


def whole_text(text: Column) -> Column:
    """The text as ``TextLeaves`` takes it: valid UTF-8, a null one empty."""
    return F.coalesce(F.make_valid_utf8(text), F.lit(""))


def word_characters(spark: SparkSession) -> np.ndarray:
    """First and last code points (n x 2) of the ranges that ``WORD_PATTERN`` takes, as
    Spark's own regular expressions read it; asked for once in a process."""
    if not _word_characters:
        points = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF))
        text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = points.filter(F.regexp_like(text, F.lit(f"^(?:{WORD_PATTERN})$"))).select("id").toArrow()
        ids = np.sort(found.column(0).to_numpy())
        gap = np.flatnonzero(np.diff(ids) != 1)
        _word_characters.append(np.stack([ids[np.concatenate([[0], gap + 1])], ids[np.concatenate([gap, [len(ids) - 1]])]], 1))
    return _word_characters[0]


_word_characters: list[np.ndarray] = []


def byte_blocks(texts: pa.Array, rows: int, size: int):
    """(start, rows) of the slices of ``texts`` with at most ``rows`` values and ``size`` bytes, one value at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        fit = np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right") - at
        n = int(max(1, min(rows, fit)))
        yield at, n
        at += n


# What a byte of a text belongs to: a space character, a word, or a token of one
# character, of which it is the first byte or another one.
_SPACE, _WORD, _SINGLE, _REST = 0, 1, 2, 3


def _kinds(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The kind of every byte of valid UTF-8."""
    is_word = np.zeros(256, bool)
    for first, last in words[words[:, 0] < 128]:
        is_word[first:last + 1] = True
    table = np.where(is_word, _WORD, _SINGLE).astype(np.int8)
    table[list(SPACE_BYTES)] = _SPACE
    table[128:] = _WORD
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))).astype(np.int64)
        for k in (1, 2, 3):
            has = size > k
            point[has] = point[has] << 6 | (data[lead[has] + k] & 0x3F)
        at = np.searchsorted(words[:, 0], point, "right") - 1
        single = point > words[at, 1]
        for k in range(4):
            kind[lead[single & (size > k)] + k] = _REST if k else _SINGLE
    return kind


class TextLeaves:
    """The layout tree's leaves of a block of texts (``whole_text``), of all texts end to
    end: ``depth``, ``sib``, ``word`` (a token of letters, digits and '_'), ``blank`` (a
    line without tokens); ``count`` is each text's number of leaves. ``tokens`` cuts
    them out. ``words`` are the ``word_characters``."""

    def __init__(self, texts: pa.Array, words: np.ndarray):
        # every text ends with a line's end, so no token goes over into the next
        ended = pc.binary_join_element_wise(texts.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
        ends = np.frombuffer(ended.buffers()[1], np.int64)[:len(ended) + 1]
        self.data = data = np.frombuffer(ended.buffers()[2], np.uint8)[:ends[-1]]
        kind = _kinds(data, words)
        in_word = kind == _WORD
        start = np.flatnonzero((kind == _SINGLE) | (in_word & (np.concatenate([[_SPACE], kind[:-1]]) != _WORD)))
        after = np.concatenate([kind[1:], [_SPACE]])
        end = np.flatnonzero((in_word & (after != _WORD)) | ((kind >= _SINGLE) & (after != _REST))) + 1
        line_end = np.flatnonzero(data == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        tokens_until = np.searchsorted(start, line_end)
        n = np.diff(tokens_until, prepend=0)            # tokens of a line
        n_lines = np.diff(np.searchsorted(line_end, ends[1:] - 1) + 1, prepend=0)
        no_token = n == 0
        at = tokens_until[no_token]
        self.start = np.insert(start, at, line_start[no_token])
        self.end = np.insert(end, at, line_end[no_token])
        self.word = np.insert(in_word[start], at, False)
        leaves = np.maximum(n, 1)                       # of a line
        self.blank = np.repeat(no_token, leaves)
        self.sib = np.where(self.blank, np.repeat(ranges(n_lines), leaves), ranges(leaves)).astype(np.int32)
        # one line and it is empty: the text is empty, its root is the leaf
        root = self.blank & np.repeat(np.repeat(n_lines == 1, n_lines), leaves) & (self.start == self.end)
        self.depth = np.where(root, 0, np.where(self.blank, 1, 2)).astype(np.int32)
        self.count = np.diff(np.cumsum(leaves)[np.cumsum(n_lines) - 1], prepend=0)

    def tokens(self, chosen: np.ndarray) -> pa.Array:
        """The tokens of the leaves that the mask ``chosen`` names, in order."""
        start, end = self.start[chosen], self.end[chosen]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        data = self.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def layout_token_counts(df: DataFrame, col: str) -> DataFrame:
    """(token, n): how often each different token of a block of texts stands in it. The
    tokens are B3's, of the whole texts, without the lines that have none; a token
    has a row for every block it is in. Map-only, for ``build_vocab(..., times="n")``."""
    ship_package_by_value()
    words = word_characters(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            for i, n in byte_blocks(texts, BLOCK_ROWS, BLOCK_BYTES):
                leaves = TextLeaves(texts.slice(i, n), words)
                counts = leaves.tokens(~leaves.blank).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["token", "n"])
    return df.select(whole_text(F.col(col)).alias("text")).mapInArrow(frugal(run), "token string, n long")


def layout_leaves(df: DataFrame, key: str, col: str,
                  pattern: str = TOKEN_PATTERN) -> DataFrame:
    """B3 as leaf rows: (key, leaf_pos, token, depth, sib). Map-only."""
    return (df.select(key, F.posexplode(layout_leaf_array(F.col(col), pattern))
                      .alias("leaf_pos", "leaf"))
              .select(key, F.col("leaf_pos").cast("int").alias("leaf_pos"),
                      "leaf.token", "leaf.depth", "leaf.sib"))


# --------------------------------------------------------------------------
# B1: markup tree
# --------------------------------------------------------------------------

def _walked(df: DataFrame, key: str, col: str, nest_tags: Iterable[str], rows, schema: str) -> DataFrame:
    """Run the page walk over Arrow batches; ``rows(key, leaves, stray, unclosed)``
    gives the output rows of a page. A null page is taken as empty."""
    ship_package_by_value()
    tags = frozenset(t.lower() for t in nest_tags)

    def run(batches):
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend(rows(k, *markup_walk(text or "", tags)))
            for i in range(0, len(out), 50_000):
                cols = list(zip(*out[i:i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
    kind = df.select(key).schema[0].dataType
    types = [to_arrow_type(kind)] + [{"int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    names = [key] + [x.split()[0] for x in schema.split(", ")]
    return df.select(key, col).mapInArrow(run, f"`{key}` {kind.simpleString()}, {schema}")


def markup_leaves(df: DataFrame, key: str, col: str,
                  nest_tags: Iterable[str] = NEST_TAGS) -> DataFrame:
    """B1: nested markup -> (key, leaf_pos, token, depth, sib).

    A page is one value of the table and is walked where it lies, with a stack
    of its open tags (``markup``): no shuffle, time linear in the page. Every page has a
    leaf; ``markup_faults`` lists pages whose tags do not match.
    """
    def rows(k, leaves, stray, unclosed):
        return [(k, i, *leaf) for i, leaf in enumerate(leaves)]
    return _walked(df, key, col, nest_tags, rows, "leaf_pos int, token string, depth int, sib int")


def markup_faults(df: DataFrame, key: str, col: str,
                  nest_tags: Iterable[str] = NEST_TAGS) -> DataFrame:
    """Pages with close tags that nothing opened (stray) or open tags that
    nothing closed (unclosed), counted."""
    def rows(k, leaves, stray, unclosed):
        return [(k, stray, unclosed)] if stray or unclosed else []
    return _walked(df, key, col, nest_tags, rows, "stray int, unclosed int")


# --------------------------------------------------------------------------
# B2: parent-pointer node table
# --------------------------------------------------------------------------

def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, num, sib, last, parent_num, first_kid): nodes numbered
    by (parent, ord, node id), so the children of a parent have adjacent numbers.

    The order is ranked over all parents (``splits.global_rank``), so a parent
    with very many children is not ranked in one task; joins on the parent meet
    one row of each, and AQE splits a hot one.
    """
    from .splits import global_rank
    ranked = written(global_rank(nodes.select("parent_id", "ord", "node_id"), ["parent_id", "ord", "node_id"])
                     .select("node_id", "parent_id", F.col("rank").alias("num")), "nodes")
    kids = (ranked.filter(F.col("parent_id").isNotNull()).groupBy("parent_id")
            .agg(F.min("num").alias("first_kid"), F.count(F.lit(1)).alias("kids")))
    kids = written(kids.join(ranked.select(F.col("node_id").alias("parent_id"), F.col("num").alias("parent_num")), "parent_id", "left"), "kids")
    out = ranked.join(kids.select("parent_id", F.col("first_kid").alias("_first"), F.col("kids").alias("_kids"), "parent_num"), "parent_id", "left")
    own = kids.select(F.col("parent_id").alias("node_id"), "first_kid")
    return (out.join(own, "node_id", "left")
            .select("node_id", "parent_id", "num", F.coalesce(F.col("num") - F.col("_first"), F.lit(0)).cast("int").alias("sib"),
                    (F.col("num") + 1 == F.col("_first") + F.col("_kids")).alias("last"), "parent_num", "first_kid"))


def euler_tour(numbered: DataFrame) -> DataFrame:
    """The walk down and up every node as list rows: entering node n is id 2n,
    leaving it 2n + 1. Weights: nodes entered, depth gained, leaves entered. A leaf
    is left as soon as it is entered, so both are one row, 2n."""
    leaf = F.col("first_kid").isNull()
    up_next = F.when(F.col("parent_id").isNotNull(), F.when(F.col("last"), 2 * F.col("parent_num") + 1).otherwise(2 * F.col("num") + 2))
    one = lambda n: F.lit(n).cast("bigint")
    down = F.struct((2 * F.col("num")).alias("id"), F.when(leaf, up_next).otherwise(2 * F.col("first_kid")).alias("next"),
                    F.col("parent_id").isNull().alias("head"), one(1).alias("pre"), F.when(leaf, one(0)).otherwise(one(1)).alias("depth"),
                    leaf.cast("bigint").alias("leaf"))
    up = F.struct((2 * F.col("num") + 1).alias("id"), up_next.alias("next"), F.lit(False).alias("head"),
                  one(0).alias("pre"), one(-1).alias("depth"), one(0).alias("leaf"))
    return numbered.select(F.explode(F.when(leaf, F.array(down)).otherwise(F.array(down, up))).alias("e")).select("e.*")


def node_order(nodes: DataFrame, base: int = BASE) -> DataFrame:
    """(node_id, root_id, pre, depth, sib, leaf_pos) of every node that a root
    leads to: its place in the pre-order of its tree, its depth, its sibling index
    and, for leaves, its place among the tree's leaves (else null).

    nodes: (node_id, parent_id, ord, text), node_id unique; roots have a null
    parent. The Euler tour is a linked list per tree; its running sums
    (``listrank``) give places and depths, with storage linear in the nodes at any
    depth. Orphans and nodes on cycles are on no list with a root at its head and
    are left out (see ``unreached_nodes``).
    """
    numbered = written(numbered_nodes(nodes), "numbered")
    ranks = list_rank(euler_tour(numbered), ["pre", "depth", "leaf"], base)
    down = ranks.filter(F.col("id") % 2 == 0).select((F.col("id") / 2).cast("bigint").alias("num"), (F.col("root") / 2).cast("bigint").alias("_root"),
                                                     "pre", "depth", "leaf")
    roots = numbered.filter(F.col("parent_id").isNull()).select(F.col("num").alias("_root"), F.col("node_id").alias("root_id"))
    return (down.join(numbered.select("num", "node_id", "sib", "first_kid"), "num").join(roots, "_root")
            .select("node_id", "root_id", "pre", F.col("depth").cast("int").alias("depth"), "sib",
                    F.when(F.col("first_kid").isNull(), F.col("leaf")).alias("leaf_pos")))


def node_leaves(nodes: DataFrame, base: int = BASE) -> DataFrame:
    """B2: (node_id, root_id, leaf_pos, depth, sib, text) for every leaf.

    Sibling index = place among all children of the parent by ``ord`` (roots:
    0). Leaves = nodes that are nobody's parent, in pre-order by ``leaf_pos``.
    """
    return (node_order(nodes, base).filter(F.col("leaf_pos").isNotNull()).join(nodes.select("node_id", "text"), "node_id")
            .select("node_id", "root_id", "leaf_pos", "depth", "sib", "text"))


def unreached_nodes(nodes: DataFrame, base: int = BASE) -> DataFrame:
    """Nodes not reachable from any root: orphans and cycle members."""
    return nodes.join(node_order(nodes, base).select("node_id"), "node_id", "left_anti")


def node_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, root_id, depth, path): the ords from the root to every node that
    a root leads to, for users who want the path itself.

    The result holds a path per node, so it is as large as nodes x depth; places
    and depths alone come from ``node_order``. Pointer doubling: each node holds
    the path from below some ancestor to itself; a round joins the unfinished
    nodes with their ancestors' rows and so doubles the paths. Only parents can be
    ancestors, so only they take part; the other nodes then meet their parents'
    whole paths in one join.
    """
    state = written(nodes.select("node_id", F.col("parent_id").alias("up"),
                                 F.when(F.col("parent_id").isNull(), F.col("node_id")).alias("root_id"),
                                 F.array("ord").alias("path")), "nodes")
    parents = state.filter("up is not null").select(F.col("up").alias("node_id")).distinct()
    rest = state.join(parents, "node_id", "left_anti")
    inner = written(state.join(parents, "node_id", "left_semi"), "parents")
    total, reach = inner.count(), 1
    while reach <= total and not inner.filter("up is not null").isEmpty():
        inner = written(inner.filter("up is null").unionByName(_below(inner, inner)), "parents")
        reach *= 2
    done = inner.filter("up is null")
    return (done.unionByName(rest.filter("up is null")).unionByName(_below(rest, done))
            .select("node_id", "root_id", (F.size("path") - 1).alias("depth"), "path"))


def _below(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The unfinished ``rows`` with the paths of the nodes that theirs begin below."""
    above = above.select(F.col("node_id").alias("a_id"), F.col("up").alias("a_up"),
                         F.col("root_id").alias("a_root"), F.col("path").alias("a_path"))
    return (rows.filter("up is not null").join(above, F.col("up") == F.col("a_id"))
            .select("node_id", F.col("a_up").alias("up"), F.col("a_root").alias("root_id"), F.concat("a_path", "path").alias("path")))


# --------------------------------------------------------------------------
# Leaf rows -> aligned arrays
# --------------------------------------------------------------------------

def leaf_arrays(leaves: DataFrame, key: str, order: str = "leaf_pos") -> DataFrame:
    """(key, tokens, tree_mask, depths, sibs) in visit order.

    One row per key, so each group is one document's leaves (bounded by
    the size of that document's own text).
    """
    s = F.sort_array(F.collect_list(F.struct(order, "token", "depth", "sib")))
    return (leaves.groupBy(key).agg(s.alias("s"))
                  .select(key,
                          F.transform("s", lambda x: x["token"]).alias("tokens"),
                          F.transform("s", lambda x: F.lit(1)).alias("tree_mask"),
                          F.transform("s", lambda x: x["depth"]).alias("depths"),
                          F.transform("s", lambda x: x["sib"]).alias("sibs")))
