"""Operator 5: similarity join of documents on word n-grams, with components.

Documents are sets of 5-word shingles (64-bit hashes); two link at a Jaccard
similarity of 0.8 or more. The join is exact; it follows the adaptive
multi-match prefix scheme:

1. Every shingle's document frequency is counted over all documents. Tasks hand
   on packed, pre-counted hashes by hash range; each range writes the
   frequencies of shingles that occur more than once, on a logarithmic scale,
   into its part of an array of fixed size (2^26 bytes). Where two shingles
   share a cell the higher value stands: the array only orders shingles, and a
   value of 0 proves that a shingle occurs once.
2. A document's shingles are ordered by (value, hash). With n shingles and at
   least t = ceil(0.8 n) in common with any partner, two linked documents share
   l shingles of their first n - t + l. Each document lengthens its prefix to
   the l (1 to MAX_MATCHES) at which the estimated cost, the prefix's list
   lengths plus the verification of the candidates that can still share l of
   them, is lowest; a pair is a candidate if it shares min(l, l') shingles.
   Shingles that occur once are left out, so most documents send nothing; a
   document with fewer than t shingles that occur elsewhere links with nothing,
   and a pair must have enough of them on both sides for its two sizes.
3. Documents with equal sets are one class from here on. Classes that share a
   prefix shingle first meet only one pivot of it (rounds of stars); once linked
   ones are one component, all pairs of classes from different components that
   share enough prefix shingles are verified. A large group of near copies thus
   costs about one verification each, and no pair inside a component is made.
   A shared shingle at places i, i' of the two orders leaves room for at most
   min(i, i') shared ones before it and the shorter rest after it; pairs whose
   sizes need more are not made. Nor are pairs whose parity bitmaps differ too
   much: every shingle flips one of 1024 bits of its class, so two bitmaps differ
   in at most as many bits as one set has shingles that the other lacks, and
   linked sets lack at most (n + n') / 9. Both conditions stand inside the joins,
   before a row is made, so a large group of copies that come near the threshold
   without reaching it makes few rows. No link between different components is
   lost, so the components are exact.

Defined results: null text or no words: no shingles, linked with nothing, own
component; fewer than 5 words: the whole sequence as one shingle; texts of any
length take part whole (time linear in them); equal rows are in one component, a
similarity of exactly 0.8 links; rows with a null key take part, a component's id
is its smallest non-null key (null if it has none); columns other than key and
text are not read, whatever their names (``one_of_each`` carries them through);
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch
from .texts import blocks, column, release, ship_by_value, worker_state

WIDTH = 5                   # words of a shingle
SHARE = (4, 5)              # similarity of 0.8 as a fraction
CELL_BITS = 26              # cells of the frequency array
STEPS = 4                   # values for each doubling of the frequency
MAX_MATCHES = 4
VERIFY_COST = 8.0           # a verification against one entry of a list
ROUNDS = 3                  # rounds of stars before the exact pairs, fewer if one joins nothing
PARITY_BITS = 1024          # bits of a class's parity bitmap
HELD = 2_000_000            # hashes that a task gathers before it sends them
BLOCK = 500_000             # characters worked on at once
NO_KEY = 1 << 62            # class ids from here on stand for rows without a key
U = np.uint64
PRIME = 0x100000001B3


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (wraps modulo 2^64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of PRIME and of its inverse modulo 2^64, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def reach(self, n: int):
        if len(self.up) < n:
            inverse = pow(PRIME, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U))]) for b in (PRIME, inverse))
        return self.up[:n], self.down[:n]


def shingles(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and
    how many each text has."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]       # bytes: A-Z only
    buf = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(b) + 1 for b in raw])])
    white = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    up, down = powers.reach(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * up[:-1], dtype=U)])
    word = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))
    doc = np.searchsorted(edge, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    odd = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
    padded = np.concatenate([word, np.zeros(WIDTH, U)])
    pos = np.arange(len(word))
    left = first[doc] + n_words[doc] - pos              # words from here to the text's end
    begin = np.flatnonzero((left >= WIDTH) | ((pos == first[doc]) & (n_words[doc] < WIDTH)))
    h = np.zeros(len(begin), U)
    for k in range(WIDTH):
        h += np.where(left[begin] > k, padded[begin + k], U(0)) * odd[k]
    h = mixed(h + np.minimum(left[begin], WIDTH).astype(U))
    doc = doc[begin]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def signatures(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each set."""
    if not len(h):
        return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)]) for v in (h, mixed(h ^ U(0x5851F42D4C957F2D)))]
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def parities(h: np.ndarray, n: np.ndarray, which: list[int]) -> list:
    """Parity bitmaps (as lists of 64-bit integers) of the sets ``which``, None of the others."""
    out, first = [None] * len(n), np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, len(which), 1024):
        part = which[lo:lo + 1024]
        bit = [((h[first[i]:first[i + 1]] >> U(17)).astype(np.int64) & (PARITY_BITS - 1)) + k * PARITY_BITS for k, i in enumerate(part)]
        flips = np.bincount(np.concatenate(bit), minlength=len(part) * PARITY_BITS).astype(np.uint8) & 1
        words = np.packbits(flips.reshape(len(part), PARITY_BITS), axis=1, bitorder="little").view("<i8")
        for i, w in zip(part, words):
            out[i] = w
    return out


def part_bits(spark) -> int:
    """log2 of the hash ranges that frequencies are summed in."""
    return min(16, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2))


def frequencies(docs: DataFrame, text: str) -> bytes:
    """The array of 2^CELL_BITS frequency values over all documents, packed by
    hash range (the driver only hands the parts on)."""
    ship_by_value()
    bits = part_bits(docs.sparkSession)

    def send(held):
        v, c = np.unique(np.concatenate(held), return_counts=True)
        part = (v >> U(64 - bits)).astype(np.int64)
        low = ((v >> U(32 - bits)) & U(0xFFFFFFFF)).astype("<u4")
        edge = np.searchsorted(part, np.arange((1 << bits) + 1))
        rows = [(p, low[a:b][c[a:b] == 1].tobytes(), low[a:b][c[a:b] > 1].tobytes(), c[a:b][c[a:b] > 1].astype("<u4").tobytes())
                for p, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if a < b]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                          names=["part", "once", "often", "n"])

    def count(batches):
        powers, held, size, seen = worker_state("powers", Powers), [], 0, set()
        for batch in batches:
            texts = column(batch, "text")
            for lo, hi in blocks([t or "" for t in texts], BLOCK):
                h, n = shingles(texts[lo:hi], powers)
                a, b = signatures(h, n)
                fresh = np.zeros(len(n), bool)          # copies within a task count once
                for i, s in enumerate(zip(a.tolist(), b.tolist())):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                h = h[np.repeat(fresh, n)]
                if len(h):
                    held.append(h)
                    size += len(h)
                if size > HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)
        held = seen = None
        release("powers")

    def merge(table):
        part = table.column("part")[0].as_py()
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), "<u4")
        often, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4") for c in ("often", "n"))
        v, inv = np.unique(np.concatenate([once, often]), return_inverse=True)
        total = np.bincount(inv, np.concatenate([np.ones(len(once)), n]), len(v))
        many = total > 1
        cells = np.zeros(1 << (CELL_BITS - bits), np.uint8)
        value = np.minimum(255, np.floor(STEPS * np.log2(total[many]))).astype(np.uint8)
        np.maximum.at(cells, v[many] >> np.uint32(32 - (CELL_BITS - bits)), value)
        return pa.table({"part": pa.array([part], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())})

    sent = docs.select(F.col(text).alias("text")).mapInArrow(count, "part int, once binary, often binary, n binary")
    rows = sent.groupBy("part").applyInArrow(merge, "part int, cells binary").collect()      # 2^CELL_BITS bytes at most
    return pickle.dumps((bits, {r["part"]: bytes(r["cells"]) for r in rows}))


def unpacked(packed: bytes) -> np.ndarray:
    """The frequency array from the packed parts of the hash ranges."""
    bits, parts = pickle.loads(packed)
    out = np.zeros((1 << bits, 1 << (CELL_BITS - bits)), np.uint8)
    for p in list(parts):
        out[p] = np.frombuffer(zlib.decompress(parts.pop(p)), np.uint8)
    return out.reshape(-1)


def prefix_of(value: np.ndarray, n: int) -> tuple[int, int]:
    """(matches l, prefix length) of the lowest estimated cost; ``value``: the
    frequency values of a document's shingles in order."""
    least = -(-SHARE[0] * n // SHARE[1])
    plain = n - least + 1
    top = min(MAX_MATCHES, least)
    lists = np.where(value[:plain + top - 1] > 0, np.exp2(value[:plain + top - 1] / STEPS), 0.0)
    upto = np.cumsum(lists)
    if upto[plain - 1] == 0:
        return 1, plain
    costs = [upto[plain + m - 2] * (1 + VERIFY_COST / m) for m in range(1, top + 1)]
    m = int(np.argmin(costs)) + 1
    return m, plain + m - 1


def signed(docs: DataFrame, key: str, text: str, shared) -> DataFrame:
    """key, h (hash of the text), a, b, n of each document; of those with prefix shingles that occur
    elsewhere also m (matches), w (shingles that occur elsewhere, at most), tokens, bits (parity bitmap)
    and set (all hashes, packed). ``shared``: the broadcast frequency array."""
    ship_by_value()
    name = uuid.uuid4().hex
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        powers, seen = worker_state("powers", Powers), set()
        held = worker_state("frequencies", dict)        # unpacked once in a worker
        if held.get("name") != name:
            held.update(name=name, cells=unpacked(shared.value))
            shared.__dict__.pop("_value", None)         # the broadcast keeps no copy in the worker
        value_of = held["cells"]
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(batch.schema.get_field_index("key"))
            for lo, hi in blocks([t or "" for t in texts], BLOCK):
                h, n = shingles(texts[lo:hi], powers)
                a, b = signatures(h, n)
                value = value_of[(h >> U(64 - CELL_BITS)).astype(np.int64)]
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, value, doc))
                h2, v2 = h[order], value[order]
                at = np.concatenate([[0], np.cumsum(n)])
                m, w, tokens, sets = ([None] * len(n) for _ in range(4))
                for i, s in enumerate(zip(a.tolist(), b.tolist())):
                    if n[i] == 0 or s in seen:          # a class is described once in a task
                        continue
                    seen.add(s)
                    own = v2[at[i]:at[i + 1]]
                    l, size = prefix_of(own, int(n[i]))
                    w[i] = int((own > 0).sum())
                    if SHARE[1] * w[i] < SHARE[0] * n[i]:       # too few can be shared
                        continue
                    take = h2[at[i]:at[i] + size][own[:size] > 0]
                    if len(take):
                        m[i], tokens[i], sets[i] = l, take.view(np.int64), h[at[i]:at[i + 1]].astype("<u8").tobytes()
                bits = parities(h, n, [i for i in range(len(n)) if tokens[i] is not None])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), pa.array(m, pa.int32()), pa.array(w, pa.int64()),
                     pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                    names=["key", "h", "a", "b", "n", "m", "w", "tokens", "bits", "set"])
        value_of = None
        held.clear()
        release("frequencies", "powers")        # the next stage needs the memory more than the next task the time
    return rows.mapInArrow(
        run, f"key {kind}, h bigint, a bigint, b bigint, n bigint, m int, w bigint, tokens array<bigint>, bits array<bigint>, set binary")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) whose sets link."""
    ship_by_value()
    one = classes.select(F.col("c").alias("x"), F.col("set").alias("sx"))
    two = classes.select(F.col("c").alias("y"), F.col("set").alias("sy"))

    def run(batches):
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(column(batch, "sx"), column(batch, "sy"))):
                s, t = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                both = int((s[at] == t).sum())
                if SHARE[1] * both >= SHARE[0] * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(keep, pa.int64())) for c in "xy"],
                                             names=["x", "y"])
    return pairs.join(one, "x").join(two, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint")


def components(links: DataFrame, table: Scratch) -> DataFrame:
    """links(x, y) -> c, comp (smallest class it reaches): smallest label of the
    neighbours, then the label's own label, until nothing changes."""
    both = table(links.select("x", "y").union(links.select("y", "x")).distinct().toDF("x", "y"), "join-links")
    label = table(both.groupBy(F.col("x").alias("c")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "join-labels")
    while True:
        near = (both.join(label.select(F.col("c").alias("y"), "comp"), "y").groupBy(F.col("x").alias("c"))
                .agg(F.min("comp").alias("low")))
        new = label.join(near, "c").select("c", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = label.select(F.col("c").alias("comp"), F.col("comp").alias("next"))
        new = table(new.join(jump, "comp").select("c", "old", F.least("comp", "next").alias("comp")), "join-labels")
        if new.filter("old <> comp").limit(1).count() == 0:
            return new.select("c", "comp")
        label = new.select("c", "comp")


def room(n1, n2, i1, i2, r1, r2):
    """Around a shared shingle with i shingles before it and r from it on (of
    those that occur elsewhere), as many can be shared as a link needs."""
    return (F.least(i1, i2) + F.least(r1, r2)) * (SHARE[0] + SHARE[1]) >= (n1 + n2) * SHARE[0]


def can_link(n1, n2, i1, i2, r1, r2):
    """The sizes are near enough for a link, and there is room for it."""
    return (F.greatest(n1, n2) * SHARE[0] <= F.least(n1, n2) * SHARE[1]) & room(n1, n2, i1, i2, r1, r2)


def parities_allow(n1, n2, bits1, bits2):
    """The parity bitmaps differ in no more bits than linked sets can:
    (|union| - |intersection|) / (|union| + |intersection|) is at most (1 - 0.8) / (1 + 0.8)."""
    differ = F.bit_count(bits1[0].bitwiseXOR(bits2[0]))
    for k in range(1, PARITY_BITS // 64):
        differ = differ + F.bit_count(bits1[k].bitwiseXOR(bits2[k]))
    return differ * (SHARE[0] + SHARE[1]) <= (n1 + n2) * (SHARE[1] - SHARE[0])


def labelled(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return entries.withColumn("comp", F.col("c"))
    return entries.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def apart(entries: DataFrame) -> DataFrame:
    """Entries of tokens that classes of different components share."""
    mixed_tokens = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return entries.join(mixed_tokens, "token")


def meeting(left: str, right: str):
    """Whether the classes of two entries can link, and are not one component yet."""
    of = lambda side: [F.col(f"{side}.{c}") for c in "nir"]
    return (F.col(f"{left}.comp") != F.col(f"{right}.comp")) & can_link(*[x for two in zip(of(left), of(right)) for x in two])


def star_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """Each class with the one pivot, of its tokens' pivots, that shares most
    of its tokens. The pivot of a token is the first class in this round's order."""
    rank = F.struct((F.col("c") if turn == 0 else F.xxhash64("c", F.lit(turn))).alias("rank"), "c", "comp", "n", "i", "r")
    pivot = entries.groupBy("token").agg(F.min(rank).alias("p")).select("token", "p.*")
    met = (entries.alias("x").join(pivot.alias("y"), (F.col("x.token") == F.col("y.token")) & meeting("x", "y"))
           .groupBy(F.col("x.c").alias("x"), F.col("y.c").alias("y")).agg(F.count(F.lit(1)).alias("shared")))
    return met.groupBy("x").agg(F.max(F.struct("shared", (-F.col("y")).alias("back"))).alias("b")).select("x", (-F.col("b.back")).alias("y"))


def cross_pairs(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of classes of different components that can link and share min(m, m') tokens."""
    entries = entries.join(classes.select("c", "bits"), "c")
    alike = parities_allow(*[F.col(f"{side}.{c}") for c in ("n", "bits") for side in "xy"])
    met = entries.alias("x").join(entries.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & meeting("x", "y") & alike)
    return (met.groupBy(F.col("x.c").alias("x"), F.col("y.c").alias("y"), F.least("x.m", "y.m").alias("least")).agg(F.count(F.lit(1)).alias("shared"))
            .filter("shared >= least").select("x", "y"))


def similar(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (shingles), component of each row, and ``h``, ``grp``: hash of the
    text and inner id of the component (null without words)."""
    table = Scratch(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text))
    rows = table(signed(docs, key, text, shared), "join-sets")
    shared.unpersist()
    no_key = F.lit(NO_KEY) + F.shiftrightunsigned(F.xxhash64("a", "b", "n"), 3)
    reps = rows.filter("n > 0").groupBy("a", "b", "n").agg(F.min("key").cast("bigint").alias("rep"))
    reps = table(reps.withColumn("c", F.coalesce("rep", no_key)).drop("rep"), "join-classes")
    described = rows.filter("tokens is not null").select("a", "b", "n", "m", "w", "tokens", "bits", "set").dropDuplicates(["a", "b", "n"])
    classes = table(described.join(reps, ["a", "b", "n"]).select("c", "n", "m", "w", "tokens", "bits", "set"), "join-described")
    # tokens stand in order, so their index is the number of shared ones before
    entries = classes.select("c", "n", "m", "w", F.posexplode("tokens").alias("i", "token"))
    entries = entries.withColumn("r", F.col("w") - F.col("i")).drop("w")
    entries = table(apart(labelled(entries, None)).drop("comp"), "join-entries")
    links, comps, turn, joined = None, None, 0, True
    while turn <= ROUNDS:
        # stars while they join components, then all pairs that are left
        turn = turn if joined else ROUNDS
        left = apart(labelled(entries, comps))
        pairs = star_pairs(left, turn) if turn < ROUNDS else cross_pairs(left, classes)
        found = table(verified(pairs, classes), "join-found")
        joined = not found.isEmpty()
        if joined or comps is None:
            links = found if links is None else links.union(found)
            comps = components(links, table)
        turn += 1
    of = reps.join(comps, "c", "left").select("a", "b", "n", F.coalesce("comp", "c").alias("comp"))
    # a class that fills a third of the rows makes the rows' side skewed: AQE splits it
    out = rows.select("key", "h", "a", "b", "n").join(of, ["a", "b", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("key")).when(F.col("comp") < NO_KEY, F.col("comp"))
    out = scratch(out.select("key", "h", "n", F.col("comp").alias("grp"), component.alias("component")), "join-components")
    table.drop()
    return out


def one_of_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one: that
    with the smallest key (of equal keys, the smallest text hash). Rows without
    words all stay."""
    rows = similar(docs, key, text).select("key", "h", "grp")
    first = F.struct(F.col("key").isNull().alias("no"), "key", "h")
    kept = rows.filter("grp is not null").groupBy("grp").agg(F.min(first).alias("f")).select("f.key", "f.h")
    alone = rows.filter("grp is null").select("key", "h").distinct()
    copies = rows.groupBy(F.col("key").alias("k3"), F.col("h").alias("h3")).agg(F.count(F.lit(1)).alias("copies"))
    same = lambda a, b, c, d: F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))
    want = (kept.withColumn("every", F.lit(False)).union(alone.withColumn("every", F.lit(True)))
            .join(copies, same("key", "k3", "h", "h3")).select(F.col("key").alias("k2"), F.col("h").alias("h2"), "every", "copies"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("k1"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h1"))
    found = wide.join(want, same("k1", "k2", "h1", "h2"))
    once = found.filter("every or copies = 1").select("_row.*")
    # rows repeated in key and text: one of them
    n = F.row_number().over(Window.partitionBy("k1", "h1").orderBy(F.lit(1)))
    twice = found.filter("not every and copies > 1").withColumn("_n", n).filter("_n = 1").select("_row.*")
    return once.unionByName(twice)
