"""Operator 11: spelling variants by Bloom-guided edit neighbourhoods.

Words at least MIN_LENGTH code points long that occur MIN_COUNT times or more
form the vocabulary. Two are near if one inserted, deleted or replaced code
point turns one into the other. Every unordered pair is tried from one side
only: the longer word drops each of its code points, and of two words of equal
length the one with the smaller code point at the differing place replaces it by
each larger letter. An edit is never built as text: its hash follows from the
word's polynomial hash and the changed place.

Edits are probed against Bloom filters, one for each word length, made of 64-bit
blocks (four bits in the one block that a hash picks), which Spark fills by an
aggregation and every task receives. Their size follows the vocabulary, about
32 bits a word; once that is more than BLOCKS blocks, the vocabulary is dealt by
hash to several waves, so a broadcast never exceeds BLOCKS * 16 bytes, and
probing is repeated for each wave. Only hashes that a filter knows leave the
task. They join the vocabulary on the hash, and the distance of the two texts
decides; so false positives and equal hashes of other words go, and nothing is
lost.

The form of a word is its most frequent near word (ties: the smallest in code
point order) if that is at least DOMINANCE times as frequent. Counts at least
double along forms, so roots (the last form) need few rounds of pointer doubling.

Defined results: null and empty texts have no words; a null key counts as empty
text in the noise rule of ``corpus_words``; words of any length take part (time
linear in it); repeated rows count again; an empty table, or one without
words of that kind, gives an empty table; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, scratch
from .texts import code_points, column, ship_by_value

MIN_LENGTH = 5
MIN_COUNT = 3
DOMINANCE = 2
ALPHABET = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))      # letters of a lower-cased word
BLOCKS = 1 << 21            # blocks of a broadcast filter
WORDS_A_BLOCK = 2
EDITS = 1 << 20             # edits probed at once
U = np.uint64
PRIME = 0x100000001B3
INVERSE = pow(PRIME, -1, 1 << 64)
ODD = U(0x9E3779B97F4A7C15)


def corpus_words(docs: DataFrame, key: str, text: str, noise: int | None = None) -> DataFrame:
    """word, n: lower-cased (A-Z) maximal runs of letters and their occurrences.
    With ``noise``, a run of which crc32("key:run") is divisible by it loses the
    code point at that number modulo its length."""
    low = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"[a-z{chr(0xC0)}-{chr(0xFF)}]+"), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        dropped = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length("run")))
        word = F.when(F.col("h") % noise == 0, dropped).otherwise(word)
    return runs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (wraps modulo 2^64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of a batch as code points, with prefix sums of their hashes."""

    def __init__(self, words: list[str]):
        cps, self.first = code_points(words)
        self.size = np.diff(self.first)
        self.word = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(cps)) - self.first[self.word]
        most = int(self.size.max(initial=0)) + 1
        up = np.concatenate([np.ones(1, U), np.cumprod(np.full(most, PRIME, U))])
        self.cps, self.power = cps.astype(U), up[place]
        terms = (self.cps + U(1)) * self.power
        sums = np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])
        self.total = sums[self.first[1:]] - sums[self.first[:-1]]
        self.before, self.after = sums[:-1] - sums[self.first[self.word]], sums[self.first[self.word + 1]] - sums[1:]
        self.repeats = np.zeros(len(cps), bool)             # the same code point stands before
        self.repeats[1:] = (cps[1:] == cps[:-1]) & (self.word[1:] == self.word[:-1])

    @staticmethod
    def finish(total, size):
        return mixed(total + size.astype(U) * ODD)

    def hashes(self) -> np.ndarray:
        return self.finish(self.total, self.size)

    def edits(self):
        """(word, length, hash) arrays of all edits, some at a time."""
        keep = np.flatnonzero(~self.repeats)                # dropping one of a run of equal ones gives the same
        for k in range(0, len(keep), EDITS):
            p = keep[k:k + EDITS]
            size = self.size[self.word[p]] - 1
            yield self.word[p], size, self.finish(self.before[p] + self.after[p] * U(INVERSE), size)
        letters = np.array([ord(c) for c in ALPHABET], U)
        step = max(1, EDITS // len(letters))
        for k in range(0, len(self.cps), step):
            p = np.arange(k, min(k + step, len(self.cps)))
            place, letter = np.nonzero(letters[None, :] > self.cps[p, None])
            p, x = p[place], letters[letter]
            size = self.size[self.word[p]]
            yield self.word[p], size, self.finish(self.total[self.word[p]] + (x - self.cps[p]) * self.power[p], size)


class Filter:
    """Blocked Bloom filters of all lengths, one after the other."""

    def __init__(self, sizes: dict[int, int], waves: int):
        self.lengths = np.array(sorted(sizes), np.int64)
        n = np.array([max(1, -(-sizes[k] // (WORDS_A_BLOCK * waves))) for k in sorted(sizes)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(n)])[:-1]
        self.n, self.total, self.bits = n.astype(U), int(n.sum()), None

    def place(self, size: np.ndarray, h: np.ndarray):
        """Which of the hashes have a filter for their length, their blocks and masks."""
        at = np.minimum(np.searchsorted(self.lengths, size), len(self.lengths) - 1)
        there = np.flatnonzero(self.lengths[at] == size)
        at, h = at[there], h[there]
        block = self.start[at] + (((h >> U(32)) * self.n[at]) >> U(32)).astype(np.int64)
        mask = np.zeros(len(h), U)
        for k in range(4):
            mask |= U(1) << ((h >> U(6 * k)) & U(63))
        return there, block, mask


def vocabulary(words: DataFrame) -> DataFrame:
    """word, n, hash, size of the words long and frequent enough."""
    ship_by_value()
    rows = words.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)).select("word", F.col("n").cast("bigint").alias("n"))

    def run(batches):
        for batch in batches:
            w = Words(column(batch, "word"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.hashes().view(np.int64)), pa.array(w.size)], names=["word", "n", "hash", "size"])
    return rows.mapInArrow(run, "word string, n bigint, hash bigint, size bigint")


def wave_of(hash_col, waves: int):
    return F.pmod(F.shiftrightunsigned(hash_col, 24), F.lit(waves))


def filled(words: DataFrame, sizes: dict[int, int], waves: int, wave: int) -> Filter:
    """The filter of one wave's words; Spark puts the blocks together."""
    f = Filter(sizes, waves)
    own = words.filter(wave_of(F.col("hash"), waves) == wave).select("hash", "size")

    def run(batches):
        for batch in batches:
            h, size = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy()
            _, block, mask = f.place(size, h)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "mask"])
    rows = own.mapInArrow(run, "block bigint, mask bigint").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()     # f.total rows at most
    f.bits = np.zeros(f.total, U)
    f.bits[rows["block"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(U)
    return f


def candidates(words: DataFrame, f, waves: int, wave: int) -> DataFrame:
    """word, hash of those of its edits that the broadcast filter knows."""
    ship_by_value()

    def run(batches):
        known = f.value
        for batch in batches:
            texts = column(batch, "word")
            for lo in range(0, len(texts), 4096):
                w, out, found = Words(texts[lo:lo + 4096]), [], []
                for word, size, h in w.edits():
                    if waves > 1:
                        own = np.flatnonzero((h >> U(24)) % U(waves) == U(wave))
                        word, size, h = word[own], size[own], h[own]
                    there, block, mask = known.place(size, h)
                    hit = there[(known.bits[block] & mask) == mask]
                    out.append(word[hit])
                    found.append(h[hit])
                which = np.concatenate([np.zeros(0, np.int64), *out])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 4096).take(pa.array(which)), pa.array(np.concatenate([np.zeros(0, U), *found]).view(np.int64))], names=["word", "hash"])
    return words.select("word").mapInArrow(run, "word string, hash bigint")


def near_pairs(words: DataFrame, table: Scratch, blocks: int = BLOCKS) -> DataFrame:
    """(word, other), each unordered near pair once."""
    spark = words.sparkSession
    sizes = {r["size"]: r["count"] for r in words.groupBy("size").count().collect()}       # one row for each length
    if not sizes:
        return words.select("word", F.col("word").alias("other")).limit(0)
    waves = max(1, -(-Filter(sizes, 1).total // blocks))
    found = None
    for wave in range(waves):
        sent = spark.sparkContext.broadcast(filled(words, sizes, waves, wave))
        some = table(candidates(words, sent, waves, wave), "spelling-candidates")
        sent.unpersist()
        found = some if found is None else found.union(some)
    other = words.select(F.col("word").alias("other"), "hash")
    return found.join(other, "hash").filter(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()


def roots(forms: DataFrame, table: Scratch) -> DataFrame:
    """forms(word, form) -> word, root: the last form, by pointer doubling."""
    now = table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = table(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if new.filter("moved").limit(1).count() == 0:
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(words: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """words(word, n) -> word, n, n_near, form, form_n, root of the words long
    and frequent enough."""
    table = Scratch(words.sparkSession)
    vocab = table(vocabulary(words), "spelling-words")
    pairs = table(near_pairs(vocab, table, blocks), "spelling-pairs")
    both = pairs.union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    ranked = both.join(vocab.select(F.col("word").alias("other"), (-F.col("n")).alias("less")), "other")
    best = ranked.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "other")).alias("b"))
    strong = F.coalesce(-F.col("b.less") >= DOMINANCE * F.col("n"), F.lit(False))
    out = table(vocab.select("word", "n").join(best, "word", "left")
                .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                        F.when(strong, F.col("b.other")).alias("form"), F.when(strong, -F.col("b.less")).alias("form_n")), "spelling-forms")
    last = roots(out.filter("form is not null").select("word", "form"), table)
    done = scratch(out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling")
    table.drop()
    return done
