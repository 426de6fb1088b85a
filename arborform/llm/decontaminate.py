"""Operator 9: benchmark decontamination under edits.

A document is contaminated by an item when a part of it is within
``floor(MAX_EDITS * length)`` edits of the item (lower-cased, any white space as
a space). The job never moves a text: items travel to the tasks in blocks of a
bounded size.

Windows. An item that allows t edits is cut into t + 2 disjoint pieces; two of
them at least survive any t edits, at places whose distance is off by t at most.
Two different pieces found so place an item-sized window; no window within t
edits is missed.

LSH. Windows and items go through the CGK random walk: at step j the symbol
under the pointer is written, and a random bit of (j, symbol) moves the pointer.
Strings at a small edit distance get walks that meet again, so the outputs, 3 n
symbols long, are close in Hamming distance. ``WALKS`` walks with ``SAMPLES``
samples of ``BITS`` positions each are compared; at 35 % differing symbols one
sample agrees with 0.65^5, so 64 of them miss with under 0.1 %. Pairs that
agree in a sample are verified by the exact edit distance (Myers' bit-parallel
search, free ends).

Short items. Under ``MIN_CHARS`` characters an edit makes another word of many an
item, so they are searched exactly: the folded item, without white space at its
ends, with no letter or digit before and after it (Aho-Corasick).

Defined results: null and empty texts, and items that are null, empty or white
space, hit nothing; repeated items are separate items; of places with equally few
edits the first one is given; repeated rows give repeated hits; texts of any
length are searched whole; all columns, whatever their names, pass through
``without_hits`` as they are; an empty table on either side gives no hits.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import blocks, code_points, column, ship_by_value, worker_state

MAX_EDITS = 0.1
MIN_CHARS = 16
WALKS, SAMPLES, BITS = 4, 16, 5
SEED = 909
ITEM_BLOCK_CHARS = 8_000_000    # items searched in one pass over the texts
P = np.uint64(0x100000001B3)
ODD = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
SIGN_CHARS = 1_000_000


def fold_table() -> np.ndarray:
    """Code point -> lower case (one to one), white space -> space."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x10000):
        c = chr(cp)
        low = c.lower()
        t[cp] = 32 if c.isspace() else ord(low) if len(low) == 1 else cp
    return t


def rolling(c: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of the q symbols from each place, by doubling."""
    h, have = None, 0
    power, width = c.astype(np.uint64), 1               # hash of `width` symbols
    while True:
        if q & width:
            if h is None:
                h, have = power, width
            else:                                       # h covers the first `have` symbols
                n = len(c) - have - width + 1
                h = h[:n] * P ** np.uint64(width) + power[have:have + n]
                have += width
        if width * 2 > q:
            return h
        n = len(power) - width
        power = power[:n] * P ** np.uint64(width) + power[width:width + n]
        width *= 2


class Items:
    """Pieces, walks and samples of a block of items."""

    def __init__(self, ids: list, texts: list[str], table: np.ndarray):
        self.table, self.short, self.short_ids = table, ahocorasick.Automaton(), {}
        for i, t in zip(ids, texts):
            folded = table[code_points([t])[0]].tobytes().decode("utf-32-le", "surrogatepass").strip(" ")
            if len(t) < MIN_CHARS and folded:
                self.short_ids.setdefault(folded, []).append(i)
                self.short.add_word(folded, folded)
        self.short.make_automaton()
        ids, texts = ([x for x, t in zip(v, texts) if len(t) >= MIN_CHARS] for v in (ids, texts))
        self.ids = ids
        self.sym = [table[code_points([t])[0]] for t in texts]
        self.len = np.array([len(s) for s in self.sym], np.int64)
        self.edits = np.floor(MAX_EDITS * self.len).astype(np.int64)
        self.by_q = {}
        if not ids:
            return
        for i, s in enumerate(self.sym):
            m = int(self.edits[i]) + 2
            step = len(s) // m
            q = min(step, 12)
            for p in range(m):
                self.by_q.setdefault(q, []).append((s[p * step:p * step + q], i, p, p * step))
        for q, rows in self.by_q.items():
            h = np.array([rolling(r[0], q)[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << TABLE_BITS, bool)
            bits[(h * ODD) >> np.uint64(64 - TABLE_BITS)] = True
            self.by_q[q] = (h[order], *(np.array([r[k] for r in rows])[order] for k in (1, 2, 3)), bits)
        rng = np.random.default_rng(SEED)
        # random bit of (step, symbol): top bit of a linear hash drawn for the step
        self.turn = rng.integers(0, 1 << 32, (WALKS, 3 * int(self.len.max()), 2), dtype=np.uint64).astype(np.uint32)
        self.at = rng.random((WALKS, SAMPLES, BITS))
        self.mix = rng.integers(1, 1 << 63, BITS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.signs = self.sign(self.sym, self.len)
        self.masks = [None] * len(texts)

    def sign(self, sym: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """[rows, WALKS * SAMPLES] hashes of the sampled walk symbols, worked out
        for strings of like length together, SIGN_CHARS at a time."""
        out = np.empty((len(sym), WALKS * SAMPLES), np.uint64)
        order, lo = np.argsort(n, kind="stable"), 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * n[order[hi]] <= SIGN_CHARS:
                hi += 1
            rows = order[lo:hi]
            out[rows] = self.sign_some([sym[i] for i in rows.tolist()], n[rows])
            lo = hi
        return out

    def sign_some(self, sym: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(sym), int(n.max()) + 1), np.uint32)
        for i, s in enumerate(sym):
            wide[i, :min(len(s), n[i])] = s[:n[i]]
        row, out = np.arange(len(sym)), []
        steps = 3 * int(n.max())
        for w in range(WALKS):
            place = np.floor(self.at[w].reshape(-1)[None, :] * (3 * n)[:, None]).astype(np.int64)
            got = np.zeros((steps, len(sym)), np.uint32)
            p = np.zeros(len(sym), np.int64)
            for j in range(steps):
                c = wide[row, np.minimum(p, n)]         # 0 behind the end
                got[j] = c
                p += (c * (self.turn[w, j, 0] | np.uint32(1)) + self.turn[w, j, 1]) >> np.uint32(31)
            bits = got[place, row[:, None]].reshape(len(sym), SAMPLES, BITS).astype(np.uint64)
            out.append((bits * self.mix).sum(2, dtype=np.uint64) + n[:, None].astype(np.uint64) * ODD)
        return np.concatenate(out, axis=1)

    def windows(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[n, 3] of text, item, first place (in ``sym``) that two pieces agree on."""
        doc, item, diag, piece = [], [], [], []
        for q, (h, its, pcs, offs, bits) in self.by_q.items():
            if len(sym) < q:
                continue
            roll = rolling(sym, q)
            at = np.flatnonzero(bits[(roll * ODD) >> np.uint64(64 - TABLE_BITS)])
            lo, hi = np.searchsorted(h, roll[at], "left"), np.searchsorted(h, roll[at], "right")
            n = hi - lo                                 # items that share the piece
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            pos = np.repeat(at, n)
            d = np.searchsorted(starts, pos, side="right") - 1
            inside = pos + q <= starts[d + 1]
            for out, v in ((doc, d), (item, its[which]), (diag, pos - offs[which]), (piece, pcs[which])):
                out.append(v[inside])
        if not doc:
            return np.zeros((0, 3), np.int64)
        doc, item, diag, piece = map(np.concatenate, (doc, item, diag, piece))
        order = np.lexsort((piece, diag, item, doc))
        doc, item, diag, piece = doc[order], item[order], diag[order], piece[order]
        hit = np.zeros(len(doc), bool)
        # another piece of the same item in the text, its place off by the edits at most;
        # pieces of one place may stand between them, so look on while anything is in reach
        reach, k = np.arange(len(doc)), 1
        while len(reach):
            reach = reach[reach + k < len(doc)]
            b = reach + k
            near = (doc[reach] == doc[b]) & (item[reach] == item[b]) & (diag[b] - diag[reach] <= self.edits[item[reach]])
            reach, b = reach[near], b[near]
            other = piece[reach] != piece[b]
            hit[reach[other]] = hit[b[other]] = True
            # a place whose window is found needs no more partners
            reach = reach[~hit[reach]]
            k += 1
        w = np.stack([doc[hit], item[hit], diag[hit]], axis=1)
        return np.unique(w, axis=0) if len(w) else w

    def search(self, texts: list[str]) -> list[tuple]:
        """(text, item, start, end, edits): the best place of each item in each text."""
        cps, starts = code_points(texts)
        sym = self.table[cps]
        return self.search_short(sym, starts) + (self.search_long(sym, starts) if self.ids else [])

    def search_short(self, sym: np.ndarray, starts: np.ndarray) -> list[tuple]:
        """The first exact place, between word boundaries, of each short item in each text."""
        if not self.short_ids:
            return []
        text, first = sym.tobytes().decode("utf-32-le", "surrogatepass"), {}
        for last, word in self.short.iter(text):
            a, b = last - len(word) + 1, last + 1
            d = int(np.searchsorted(starts, a, side="right")) - 1
            lo, hi = int(starts[d]), int(starts[d + 1])
            if b <= hi and (a == lo or not (text[a - 1].isalnum() and word[0].isalnum())) and (b == hi or not (text[b].isalnum() and word[-1].isalnum())):
                for i in self.short_ids[word]:
                    first.setdefault((d, i), (d, i, a - lo, b - lo, 0))
        return list(first.values())

    def search_long(self, sym: np.ndarray, starts: np.ndarray) -> list[tuple]:
        w = self.windows(sym, starts)
        pairs = set()
        for lo in range(0, len(w), 4096):
            part = w[lo:lo + 4096]
            n = self.len[part[:, 1]]
            cut = [sym[max(starts[d], s):min(starts[d + 1], s + k)] for (d, _, s), k in zip(part.tolist(), n.tolist())]
            signs = self.sign(cut, n)
            same = (signs == self.signs[part[:, 1]]).any(axis=1)
            pairs.update(map(tuple, part[same].tolist()))
        best = {}
        for d, i, s in sorted(pairs):
            t, a = int(self.edits[i]), int(starts[d])
            if (d, i) in best and best[d, i][0] == 0:
                continue
            lo, hi = max(a, s - 2 * t), min(int(starts[d + 1]), s + int(self.len[i]) + 2 * t)
            dist, end = self.distance(i, sym[lo:hi])
            if dist <= t and ((d, i) not in best or dist < best[d, i][0]):
                best[d, i] = (dist, max(0, lo - a + end - int(self.len[i])), lo - a + end)
        return [(d, self.ids[i], s, e, dist) for (d, i), (dist, s, e) in sorted(best.items())]

    def distance(self, i: int, text: np.ndarray) -> tuple[int, int]:
        """Smallest edit distance of the item to any part of ``text``, and where
        that part ends (bit-parallel columns in one integer)."""
        m = int(self.len[i])
        if self.masks[i] is None:
            self.masks[i] = {}
            for k, c in enumerate(self.sym[i].tolist()):
                self.masks[i][c] = self.masks[i].get(c, 0) | 1 << k
        peq, full, high = self.masks[i], (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        for j, c in enumerate(text.tolist()):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (~(xv | ph) & full), ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end


def item_blocks(items: DataFrame, key: str, text: str, limit: int = ITEM_BLOCK_CHARS):
    """The items in blocks of about ``limit`` characters, one block at a time."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") >= 1)
    ids, texts, held = [], [], 0
    for r in rows.orderBy("k").toLocalIterator():
        ids.append(r["k"])
        texts.append(r["t"])
        held += len(r["t"])
        if held >= limit:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def hits(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item, start, end (code points), edits: one row per text and item."""
    ship_by_value()
    kinds = [df.select(F.col(c).alias("c")).schema[0].dataType.simpleString() for df, c in ((docs, key), (items, item_key))]
    spec = f"key {kinds[0]}, item {kinds[1]}, start int, end int, edits int"
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") >= 1)
    out = None
    for n, (ids, texts) in enumerate(item_blocks(items, item_key, item_text)):
        shared = spark.sparkContext.broadcast(cloudpickle.dumps((ids, texts)))     # ITEM_BLOCK_CHARS

        def run(batches, shared=shared):
            table = worker_state("decontaminate fold", fold_table)
            known = Items(*cloudpickle.loads(shared.value), table)
            for batch in batches:
                ts, keys = column(batch, "text"), batch.column(batch.schema.get_field_index("key"))
                for lo, hi in blocks(ts):
                    found = known.search(ts[lo:hi])
                    if found:
                        d, i, s, e, x = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array([lo + v for v in d])), pa.array(i), pa.array(s, pa.int32()),
                             pa.array(e, pa.int32()), pa.array(x, pa.int32())], names=["key", "item", "start", "end", "edits"])
        part = rows.mapInArrow(run, spec)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], spec) if out is None else out


def without_hits(docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """The rows, all columns, that no item hits."""
    ship_by_value()
    for ids, texts in item_blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((ids, texts)))

        def run(batches, shared=shared):
            known = Items(*cloudpickle.loads(shared.value), worker_state("decontaminate fold", fold_table))
            for batch in batches:
                ts = [t or "" for t in column(batch, text)]
                keep = np.ones(len(ts), bool)
                for lo, hi in blocks(ts):
                    keep[[lo + f[0] for f in known.search(ts[lo:hi])]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
