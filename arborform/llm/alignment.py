"""Operator 13: alignment of two tokenizers, and how often their ids meet.

Every text, with a space before it, is cut into tokens by a byte-level BPE
tokenizer (A) and a sentencepiece model (B). Both cover the same bytes, so the
ends of their tokens are two sorted lists of byte offsets, and the offsets in
both lists, the shared cuts, part the text into groups. They are found by divide
and conquer: from the token in the middle of an interval outwards, ends of A are
looked up among those of B by bisection; the shared cut nearest to the middle
halves the interval, and both halves go on in the same way. An interval without
a shared cut inside is a leaf: one group. The intervals of all texts of a block
are halved together, as arrays; a round doubles the distance looked at, so an
interval costs time linear in its length.

A link is a pair of an A and a B token whose bytes overlap. Between two
neighbouring ends of either list there is one, so links are read off the merged
list. Counts of linked id pairs are summed over the corpus: in the task, then by
Spark. Each document then needs the counts of its own pairs. The most frequent
pairs (at most HOT_PAIRS, whatever the corpus) are sent to the tasks; pairs
below that count, which by that have few links each, join by a shuffle. So no
hot key is ever shuffled to one task, and no row is left out.

Tokens. B's pieces never hold a space after another character, so texts are cut
before spaces and distinct pieces are encoded once per worker (a vocabulary
without that property is encoded by whole texts). Strings of special tokens
inside a text are plain text.

Defined results: a null or empty text, or one whose tokens do not give its bytes
back (U+2581 in it, say) has no tokens, groups or links; an empty table gives an
empty table; keys may be null or repeated, every row counts and gets its own
result; of ties for the best A id of a B id all are best; a text is aligned
whole at any length; columns other than key and text are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, scratch
from .texts import blocks, column, ship_by_value, worker_state
from .token_table import Encoder

BLOCK = 1_000_000           # characters worked on at once
HELD = 4_000_000            # characters of pieces that a worker remembers
HOT_PAIRS = 1 << 21         # id pairs sent to every task, at 17 bytes each
STEPS = 8                   # steps of the count histogram for each doubling
FAR = np.iinfo(np.int64).max


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        before = np.cumsum(n) - n
        return self.data[np.repeat(self.start[ids] - before, n) + np.arange(int(n.sum()))].tobytes()


class Pieces:
    """Texts to ids of a sentencepiece model, equal to its own call on each whole text."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.entries = [bytes([int(n[1:-1], 16)]) if self.sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cut = (not any(re.search("[^▁]▁", n) for n in names) and self.sp.encode("a  b ") == [
            x for p in ("a", " b") for x in self.sp.encode(p)] + [self.sp.piece_to_id("▁")])
        self.known, self.size = {" ": np.array([self.sp.piece_to_id("▁")], "<i4").tobytes()}, 0

    def split(self, text: str) -> list[str]:
        """Pieces of space + text: each begins with its spaces."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return re.findall(" +[^ ]*", " " + text)
        return [" " + p for p in text.split(" ")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. An empty text has none."""
        if not self.cut:
            each = [np.array(x, "<i4").tobytes() for x in self.sp.encode(texts, num_threads=1)]
        else:
            # U+2581 stands for a space in the model: such texts are encoded whole
            parts = [self.split(t) if t and "▁" not in t else [] for t in texts]
            new = set().union(*parts) - self.known.keys()
            if self.size + sum(map(len, new)) > HELD:
                self.known, self.size = {" ": self.known[" "]}, 0
                new = set().union(*parts) - {" "}
            new = list(new)
            # the model puts a space before what it encodes: the piece's first one
            self.known.update((p, array("i", x).tobytes()) for p, x in zip(new, self.sp.encode([p[1:] for p in new], num_threads=1)))
            self.size += sum(map(len, new))
            known = self.known
            each = [b"".join([known[p] for p in ps]) if ps or not t else np.array(self.sp.encode(t), "<i4").tobytes() for t, ps in zip(texts, parts)]
        return np.frombuffer(b"".join(each), "<i4").astype(np.int64), np.array([len(e) // 4 for e in each], np.int64)


def middle_cuts(ends_a, ends_b, a0, a1, b0, b1):
    """For each interval (tokens a0 to a1 - 1 of A, b0 to b1 - 1 of B) the shared
    end inside it that lies nearest to its middle: the tokens of A and B that end
    there, or -1."""
    mid = (a0 + a1 - 1) // 2
    i, j = np.full(len(a0), -1), np.full(len(a0), -1)
    left, near, far = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1)), 0, 1
    while len(left):
        d = np.arange(near, far)
        away = np.concatenate([d, -d[d > 0]])
        place = mid[left, None] + away
        inside = (place >= a0[left, None]) & (place < a1[left, None] - 1)
        ends = ends_a[np.clip(place, 0, len(ends_a) - 1)]
        at = np.minimum(np.searchsorted(ends_b, ends), len(ends_b) - 1)
        hit = inside & (ends_b[at] == ends)
        best = np.where(hit, np.abs(away), FAR).argmin(axis=1)
        rows = np.arange(len(left))
        found = hit[rows, best]
        i[left[found]], j[left[found]] = place[rows, best][found], at[rows, best][found]
        left = left[~found & ((mid[left] - far >= a0[left]) | (mid[left] + far < a1[left] - 1))]
        near, far = far, 2 * far
    return i, j


def groups_of(ends_a, ends_b, a0, a1, b0, b1):
    """Leaf groups (a0, a1, b0, b1) of the intervals, in order."""
    done = [(a0[:0],) * 4]
    while len(a0):
        i, j = middle_cuts(ends_a, ends_b, a0, a1, b0, b1)
        cut = i >= 0
        done.append((a0[~cut], a1[~cut], b0[~cut], b1[~cut]))
        a0, a1, b0, b1, i, j = a0[cut], a1[cut], b0[cut], b1[cut], i[cut] + 1, j[cut] + 1
        a0, a1, b0, b1 = np.concatenate([a0, i]), np.concatenate([i, a1]), np.concatenate([b0, j]), np.concatenate([j, b1])
    out = [np.concatenate(x) for x in zip(*done)]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


class Aligner:
    def __init__(self, source_a: str, model_b: bytes):
        import json
        self.a, self.b = Encoder(source_a, 0, special=False), Pieces(model_b)
        byte, names = byte_of_character(), {i: t for t, i in json.loads(source_a)["model"]["vocab"].items()}
        entries = [bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.bytes_a, self.bytes_b = Table(entries), Table(self.b.entries)
        self.n_b = len(self.b.entries)
        most = max(len(entries), self.n_b)
        digits = [str(i).encode() for i in range(most)]
        self.n_digits = np.array([len(d) for d in digits])
        self.digits = np.zeros((most, self.n_digits.max() + 1), np.uint8)
        for i, d in enumerate(digits):
            self.digits[i, :len(d)] = list(d)

    def tokens(self, texts: list[str]):
        """Ids and number per text of A and B; none where the bytes differ."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ids_a, at = self.a.encode([" " + t if t else "" for t in texts])
        end = np.zeros(len(ids_a), bool)
        end[at[1:] - 1] = True                  # the encoder's end id after each text
        ids_a, n_a = ids_a[~end].astype(np.int64), np.diff(at) - 1
        ids_b, n_b = self.b.encode(texts)
        same = np.ones(len(texts), bool)
        for ids, n, table in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            joined, upto = table.joined(ids), np.concatenate([[0], np.cumsum(table.size[ids])])
            edge = upto[np.concatenate([[0], np.cumsum(n)])].tolist()
            same &= [joined[s:e] == r for s, e, r in zip(edge, edge[1:], raw)]
        ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        return ids_a, np.where(same, n_a, 0), ids_b, np.where(same, n_b, 0)

    def align(self, texts: list[str]):
        """n_a, n_b, n_groups, n_links; the groups' texts; linked id pairs and
        their links as (pairs, links, first of each text)."""
        ids_a, n_a, ids_b, n_b = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        some = np.flatnonzero(n_a)
        a0, a1, b0, b1 = groups_of(ends_a, ends_b, first_a[some], first_a[some + 1], first_b[some], first_b[some + 1])
        n_groups = np.bincount(np.searchsorted(first_a, a0, side="right") - 1, minlength=len(texts))
        # ids in the order of the text form: A's of a group, then B's
        in_a, in_b = np.arange(len(ids_a)) + np.repeat(b0, a1 - a0), np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[in_a], ids[in_b] = ids_a, ids_b
        mark[a1 - 1 + b0], mark[b1 - 1 + a1] = ord("|"), ord(";")
        rows, width = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), width] = mark
        text = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(width + 1)])[first_a + first_b].tolist()
        shown = [text[s:max(s, e - 1)] for s, e in zip(upto, upto[1:])]
        # one link up to each end of either list
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")       # merges two sorted runs
        ends = ends[np.diff(ends, prepend=-1) > 0]
        pair = ids_a[np.searchsorted(ends_a, ends)] * self.n_b + ids_b[np.searchsorted(ends_b, ends)]
        edge = np.concatenate([[0], ends_a])[first_a]
        doc = np.searchsorted(edge, ends, side="left") - 1
        n_links = np.bincount(doc, minlength=len(texts))
        all_pairs = len(self.digits) * self.n_b
        found, links = np.unique(doc * all_pairs + pair, return_counts=True)
        begin = np.searchsorted(found, np.arange(len(texts) + 1) * all_pairs)
        return n_a, n_b, n_groups, n_links, shown, (found % all_pairs, links, begin)


def align(df: DataFrame, key: str, text: str, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``, or its
    SHA-256 with ``digest``; '' without tokens), pairs (distinct linked pairs as
    A id * size of B + B id) and links (of each pair) of every row."""
    ship_by_value()
    with open(path_a, encoding="utf-8") as f:
        source = f.read()                       # the driver's files, shipped to the tasks
    with open(path_b, "rb") as f:
        model = f.read()
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        al = worker_state(f"aligner {zlib.crc32(source.encode())} {zlib.crc32(model)}", lambda: Aligner(source, model))
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(batch.schema.get_field_index("key"))
            for lo, hi in blocks(texts, BLOCK):
                *numbers, shown, (pairs, links, begin) = al.align(texts[lo:hi])
                shown = [hashlib.sha256(s).hexdigest() if s and digest else s.decode() for s in shown]
                begin = pa.array(begin, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), *[pa.array(n, pa.int64()) for n in numbers], pa.array(shown, pa.string()),
                     pa.ListArray.from_arrays(begin, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(begin, pa.array(links, pa.int32()))],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])
    return rows.mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, links array<int>")


def flat(batch, *names):
    """First of each row, and the values of list columns one after the other."""
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    at = lists[0].offsets.to_numpy()
    return at - at[0], [x.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]] for x in lists]


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links over all rows), best (n is the highest of its B id)."""
    ship_by_value()

    def run(batches):
        for batch in batches:
            _, (pairs, links) = flat(batch, "pairs", "links")
            u, at = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(np.bincount(at, links, len(u)).astype(np.int64))], names=["pair", "n"])
    counts = aligned.select("pairs", "links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    top = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("top"))      # a row for each B id at most
    return counts.join(F.broadcast(top), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def hot_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach, from a histogram."""
    step = F.floor(F.log2("n") * STEPS)
    hist = {r["s"]: (r["rows"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()}
    total, least = 0, 1 << 62
    for s in sorted(hist, reverse=True):        # 64 * STEPS steps at most
        total += hist[s][0]
        if total > most:
            break
        least = hist[s][1]
    return least


def with_counts(aligned: DataFrame, size_b: int, table: Scratch, most: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (a written table with a row number ``row``) with count_sum and n_best in place of pairs and links."""
    ship_by_value()
    spark = aligned.sparkSession
    counts = table(pair_counts(aligned, size_b), "pair-counts")
    least = hot_count(counts, most)
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toPandas()         # ``most`` rows at most
    sent = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def run(batches):
        code, count, best = sent.value
        if not len(code):
            code, count, best = np.array([-1]), np.zeros(1, np.int64), np.zeros(1, bool)
        for batch in batches:
            begin, (pairs, links) = flat(batch, "pairs", "links")
            at = np.minimum(np.searchsorted(code, pairs), len(code) - 1)
            hit = code[at] == pairs
            add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[begin])
            rest = pa.array(np.concatenate([[0], np.cumsum(~hit)])[begin], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")), pa.array(add(np.where(hit, links * count[at], 0))), pa.array(add(np.where(hit & best[at], links, 0))),
                 pa.ListArray.from_arrays(rest, pa.array(pairs[~hit], pa.int64())), pa.ListArray.from_arrays(rest, pa.array(links[~hit], pa.int32()))],
                names=["row", "count_sum", "n_best", "pairs", "links"])
    looked = table(aligned.select("row", "pairs", "links").mapInArrow(run, "row bigint, count_sum bigint, n_best bigint, pairs array<bigint>, links array<int>"), "pair-looked")
    sent.unpersist()
    few = (looked.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
           .join(counts.filter(F.col("n") < least), "pair")
           .select("row", (F.col("links") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("links")).otherwise(0).cast("bigint").alias("n_best")))
    sums = (looked.select("row", "count_sum", "n_best").union(few).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    return aligned.drop("pairs", "links").join(sums, "row").drop("row")


def alignments(df: DataFrame, key: str, text: str, path_a: str, path_b: str, digest: bool = True, most: int = HOT_PAIRS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups, count_sum, n_best of every row."""
    import sentencepiece
    table = Scratch(df.sparkSession)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    # row numbers stand once the table is written
    aligned = table(align(df, key, text, path_a, path_b, digest).withColumn("row", F.monotonically_increasing_id()), "aligned", {
        "parquet.writer.version": "v2", "parquet.enable.dictionary#pairs.list.element": "false"})
    out = scratch(with_counts(aligned, size_b, table, most), "alignments")
    table.drop()
    return out.withColumnRenamed("key", key)
