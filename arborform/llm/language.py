"""Operator 2: language identification with Kneser-Ney character models.

Letters are lower-cased, everything else is a space and spaces run together.
Character n-grams of order 4 are counted per language over all training texts:
each task counts its texts in arrays and hands on one row per n-gram, so what is
shuffled are counts. The interpolated Kneser-Ney probabilities of every counted
n-gram under every language are laid out in arrays sorted by the n-gram's hash;
n-grams that no language has are backed off when they are met. A text gets the
language of the lowest cross-entropy per character.

The score is the posterior of that language, with one temperature fitted on all
training rows that have a letter: each task sums the likelihood at every temperature of a
grid, and the cross-entropies of each language. A text whose cross-entropy lies far
above what the training rows of its language have is marked rejected and its score
lowered.

All counted n-grams are in the model. It is cut into parts of about
``PART_GRAMS`` of them, by ranges of the middle two symbols (third, second):
an n-gram, its contexts and all that it backs off to then lie in one part, but
for the bigrams (given to each part that has their first symbol) and the symbols
(given to all). Discounts come from counts over the whole table. Parts are built
in tasks and broadcast one after the other; a task holds parts up to
``HELD_BYTES`` and reads the others for each block of texts.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every text if no language was learnt; null languages are not learnt from;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .texts import blocks, code_points, column, ship_by_value

ORDER = 4
START = 2                   # symbol before a text's beginning
PART_GRAMS = 100_000        # (language, n-gram) rows of a part, about
HELD_BYTES = 400_000_000    # parts that a task keeps
REJECT_SD = 5.0
BETAS = np.geomspace(0.05, 8, 60)       # temperatures tried
ODD = np.uint64(0x9E3779B97F4A7C15)     # odd multiplier: n-gram -> hash, one to one
FLUSH = 2_000_000           # n-grams that a task holds before it merges them


class Symbols:
    """Code points to 16-bit symbols: lower-cased letters, else a space."""

    def __init__(self):
        self.table = np.full(0x110000, 32, np.uint16)
        for cp in range(0x10000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                self.table[cp] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else cp
        self.known = set()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each behind three START, and the text of each."""
        mark = "\U0010FFFF" * (ORDER - 1) + " "
        cps, starts = code_points([mark + t + " " for t in texts])
        high = np.unique(cps[cps >= 0x10000])
        for cp in high:
            if int(cp) not in self.known:               # rare: letters beyond 16 bits
                self.known.add(int(cp))
                if chr(cp).isalpha():
                    self.table[cp] = 0xE000 + int(cp) % 0x1900
        self.table[0x10FFFF] = START
        sym = self.table[cps]
        space = sym == 32
        keep = np.ones(len(sym), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        return sym[keep], owner[keep]


def grams(sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram that ends at each symbol of a text, and the text of each."""
    s = sym.astype(np.uint64)
    n = len(s) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = s[:n].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(16)
        key |= s[k:k + n]
    last = sym[ORDER - 1:] != START
    return key[last], owner[ORDER - 1:][last]


def summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    u, inv = np.unique(k, return_inverse=True)
    return u, np.bincount(inv, c, len(u)).astype(np.int64)


def count_grams(df: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, gram, n over all rows with a language and a text."""
    ship_by_value()
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        symbols, held = Symbols(), {}

        def rows(name):
            k, c = summed(*held.pop(name))
            for i in range(0, len(k), 100_000):
                part = k[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.view(np.int64)),
                                                  pa.array(c[i:i + 100_000])], schema=schema)
        for batch in batches:
            by = {}
            for name, t in zip(column(batch, "lang"), column(batch, "text")):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for lo, hi in blocks(texts):
                    k, c = np.unique(grams(*symbols.of(texts[lo:hi]))[0], return_counts=True)
                    ks, cs = held.setdefault(name, ([], []))
                    ks.append(k)
                    cs.append(c)
                    if sum(map(len, ks)) > FLUSH:
                        k, c = summed(ks, cs)
                        held[name] = ([k], [c])
                        if len(k) > FLUSH // 2:
                            yield from rows(name)
        for name in list(held):
            yield from rows(name)
    counted = (df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
               .mapInArrow(run, "lang string, gram bigint, n bigint"))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney over packed n-grams of one language, in sorted arrays.

    For a part of the n-grams, ``lower`` gives the whole (keys, counts) of the
    low orders and ``tallies`` how many n-grams of each order have count 1 and 2."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, letters: int, lower: dict | None = None, tallies: dict | None = None):
        self.letters, self.levels = letters, []
        for k in range(ORDER, 0, -1):
            if k == ORDER or (lower and k in lower):
                keys, counts = (keys, counts) if k == ORDER else lower[k]
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order].astype(float)
            if not len(keys):
                self.levels.append(None)
                continue
            one, two = tallies.get(k, (0, 0)) if tallies is not None else ((counts == 1).sum(), (counts == 2).sum())
            d = one / (one + 2 * two) if one and two else 0.5
            context = keys >> np.uint64(16)
            u, first = np.unique(context, return_index=True)
            mass = np.add.reduceat(counts, first)
            types = np.diff(np.append(first, len(keys)))
            self.levels.append((keys, np.maximum(counts - d, 0), u, mass, d * types / mass))
            # the next lower order counts in how many n-grams a suffix ends
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
            counts = counts.astype(float)

    def prob(self, q: np.ndarray, level: int = 0) -> np.ndarray:
        """Probability of the last symbol of each n-gram after the others."""
        if level == ORDER:
            return np.full(len(q), 1.0 / self.letters)
        low = self.prob(q & np.uint64((1 << 16 * (ORDER - 1 - level)) - 1), level + 1)
        if self.levels[level] is None:
            return low
        keys, kept, contexts, mass, rest = self.levels[level]
        c = np.minimum(np.searchsorted(contexts, q >> np.uint64(16)), len(contexts) - 1)
        seen = contexts[c] == q >> np.uint64(16)
        i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        own = np.where(keys[i] == q, kept[i], 0.0)
        return np.where(seen, own / mass[c] + rest[c] * low, low)


class Costs:
    """Cost in bits of every n-gram of some models (one per language), by hash."""

    def __init__(self, parts: list[KneserNey], every: np.ndarray):
        self.parts = parts
        hashed = every * ODD
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.costs = [(-np.log2(p.prob(every[order]))).astype(np.float32) for p in self.parts]
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(2 * len(every))))))
        edges = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(self.hashes, edges), len(every)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each n-gram, -1 if unknown: bucket by the hash's top bits,
        then along the few hashes of the bucket."""
        h = key * ODD
        b = (h >> self.shift).astype(np.int64)
        at, end = self.first[b], self.first[b + 1]
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.hashes[at[todo]] == h[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out

    def add(self, key: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Add the bits of each n-gram under each language to its text's row."""
        place = self.find(key)
        miss = np.flatnonzero(place < 0)
        new, inv = np.unique(key[miss], return_inverse=True)
        for j, p in enumerate(self.parts):
            bits = self.costs[j][place]
            if len(miss):
                bits[miss] = -np.log2(p.prob(new))[inv]
            out[:, j] += np.bincount(owner, bits, len(out))


class Model(Costs):
    """The models of all languages, in one table of costs."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], counts: list[np.ndarray]):
        every = np.unique(np.concatenate(keys))
        letters = len(np.unique(every & np.uint64(0xFFFF))) + 1
        super().__init__([KneserNey(k, c, letters) for k, c in zip(keys, counts)], every)
        self.begin(langs)

    def begin(self, langs: list[str]) -> None:
        self.langs = langs
        self.beta, self.limits = 1.0, [np.inf] * len(langs)

    def entropies(self, texts: list[str], symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per symbol of each text under each language, symbols, and
        whether the text has a letter."""
        key, owner = grams(*symbols.of(texts))
        size = np.bincount(owner, minlength=len(texts))
        letter = np.bincount(owner, (key & np.uint64(0xFFFF)) != 32, len(texts)) > 0
        out = np.zeros((len(texts), len(self.langs)))
        self.add(key, owner, out)
        return out / size[:, None], size, letter

    def judge(self, ce: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and rejection."""
        best = ce.argmin(1)
        z = -self.beta * np.sqrt(size)[:, None] * (ce - ce.min(1)[:, None])
        score = 1 / np.exp(np.maximum(z, -700)).sum(1)
        own, limit = ce.min(1), np.array(self.limits)[best]
        return best, np.where(own > limit, score * limit / own, score), own > limit

    def losses(self, ce: np.ndarray, size: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """Sum over the texts of the negative log-likelihood at each temperature;
        then texts, cross-entropies and their squares of each language."""
        row, out = np.arange(len(truth)), []
        gap = -np.sqrt(size)[:, None] * (ce - ce.min(1)[:, None])
        for beta in BETAS:
            z = beta * gap
            out.append((np.log(np.exp(z).sum(1)) - z[row, truth]).sum())
        own, n = ce[row, truth], len(self.langs)
        return np.concatenate([out, np.bincount(truth, minlength=n), np.bincount(truth, own, n), np.bincount(truth, own * own, n)])

    def calibrate(self, sums: np.ndarray) -> None:
        """Temperature by likelihood on the grid, limits by mean and deviation,
        from the sums of ``losses`` over all training texts."""
        self.beta = float(BETAS[int(np.argmin(sums[:len(BETAS)]))])
        n, own, squares = sums[len(BETAS):].reshape(3, len(self.langs))
        for j in range(len(self.langs)):
            if n[j] >= 20:
                mean = own[j] / n[j]
                self.limits[j] = float(mean + REJECT_SD * np.sqrt(max(squares[j] / n[j] - mean * mean, 0.0)))


def middle(key: np.ndarray) -> np.ndarray:
    """Third symbol of an n-gram, then its second: what parts are ranges of."""
    return ((key >> np.uint64(16)) & np.uint64(0xFFFF)) << np.uint64(16) | (key >> np.uint64(32)) & np.uint64(0xFFFF)


class Parted(Model):
    """The models of all languages, in parts by ranges of ``middle``. ``source``
    holds the broadcast parts and travels beside the model."""

    def __init__(self, langs: list[str], cuts: np.ndarray, source: list):
        self.cuts, self.source, self.held, self.room = cuts, source, {}, HELD_BYTES
        self.begin(langs)

    def __getstate__(self):
        return self.__dict__ | {"source": None, "held": {}}

    def part(self, i: int) -> Costs:
        if i in self.held:
            return self.held[i]
        data = self.source[i].value
        self.source[i].__dict__.pop("_value", None)         # the broadcast keeps no copy in the worker
        out = cloudpickle.loads(data)
        if len(data) <= self.room:
            self.room -= len(data)
            self.held[i] = out
        return out

    def add(self, key: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        if not len(self.cuts):
            return self.part(0).add(key, owner, out)
        at = np.searchsorted(self.cuts, middle(key).astype(np.int64), "right")
        at = at.astype(np.uint16 if len(self.cuts) < 1 << 16 else np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(self.cuts) + 1))
        for i, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if lo < hi:
                mine = order[lo:hi]
                self.part(i).add(key[mine], owner[mine], out)


def packed_parts(counts: DataFrame, two: DataFrame, langs: list[str], cuts: np.ndarray,
                 low: dict, tallies: dict, letters: int) -> DataFrame:
    """part, data: the pickled Costs of each range of ``middle``. counts, two(lang, gram, n)."""
    number = {x: j for j, x in enumerate(langs)}

    def dealt(order):
        def run(batches):
            for batch in batches:
                lang = np.array([number[x] for x in column(batch, "lang")], np.int32)
                gram = batch.column(batch.schema.get_field_index("gram")).to_numpy(zero_copy_only=False)
                n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
                at = middle(gram.view(np.uint64)).astype(np.int64)
                first = last = np.searchsorted(cuts, at, "right")
                if order == 2:                              # every part that has the bigram's first symbol third
                    c = at >> 16 << 16
                    first, last = np.searchsorted(cuts, c, "right"), np.searchsorted(cuts, c | 0xFFFF, "right")
                many = last - first + 1
                row = np.repeat(np.arange(len(at)), many)
                part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(np.full(len(row), order, np.int32)), pa.array(lang[row]),
                     pa.array(gram[row]), pa.array(n[row])], names=["part", "size", "lang", "gram", "n"])
        return run

    def build(table):
        get = lambda name: table.column(name).to_numpy()
        part, size, lang, gram, n = int(get("part")[0]), get("size"), get("lang"), get("gram").view(np.uint64), get("n")
        pick = lambda k, j: ((size == k) & (lang == j)).nonzero()[0]
        models = []
        for j in range(len(langs)):
            four, pair = pick(ORDER, j), pick(2, j)
            models.append(KneserNey(gram[four], n[four], letters, {2: (gram[pair], n[pair]), 1: low[j]}, tallies[j]))
        every = np.unique(gram[size == ORDER])
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([cloudpickle.dumps(Costs(models, every))], pa.binary())})
    schema = "part int, size int, lang int, gram bigint, n bigint"
    rows = counts.mapInArrow(dealt(ORDER), schema).union(two.mapInArrow(dealt(2), schema))
    return rows.groupBy("part").applyInArrow(build, "part int, data binary")


def fit(train: DataFrame, key: str, lang: str, text: str) -> Parted | None:
    spark, table = train.sparkSession, Scratch(train.sparkSession)
    cut = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")
    # in how many n-grams of the next order a shorter one ends
    shorter = lambda df, k: df.groupBy("lang", cut(k)).agg(F.count(F.lit(1)).alias("n"))
    four = table(count_grams(train, lang, text), "grams-4")
    three = table(shorter(four, 3), "grams-3")
    two = table(shorter(three, 2), "grams-2")
    one = table(shorter(two, 1), "grams-1")
    low = one.toPandas()                                    # at most 65,536 symbols per language
    if not len(low):
        table.drop()
        return None
    langs = sorted(low["lang"].unique())
    letters = low["gram"].nunique() + 1
    by = [low[low["lang"] == x] for x in langs]
    low = [(b["gram"].to_numpy().view(np.uint64), b["n"].to_numpy()) for b in by]
    every = four.withColumn("k", F.lit(4))
    for k, df in ((3, three), (2, two), (1, one)):
        every = every.union(df.withColumn("k", F.lit(k)))
    tallies = [{} for _ in langs]
    for r in every.groupBy("lang", "k").agg(F.count(F.when(F.col("n") == 1, 1)).alias("a"),
                                            F.count(F.when(F.col("n") == 2, 1)).alias("b")).collect():   # four rows per language
        tallies[langs.index(r["lang"])][r["k"]] = (r["a"], r["b"])
    at = (F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF)) * 65536 + F.shiftright("gram", 32).bitwiseAND(F.lit(0xFFFF))).cast("bigint")
    size = four.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("least")).first()
    parts = -(-size["n"] // PART_GRAMS)
    found = four.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    cuts = np.array(sorted({x for x in found if x > size["least"]}), np.int64)
    ship_by_value()
    packed = table(packed_parts(four, two, langs, cuts, low, tallies, letters), "model-parts")
    # the driver only hands the parts on, one at a time
    source = [spark.sparkContext.broadcast(bytes(packed.filter(F.col("part") == i).first()["data"])) for i in range(len(cuts) + 1)]
    model = Parted(langs, cuts, source)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = (train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("_text"))
            .mapInArrow(calibration_sums(shared, source), "sums array<double>").collect())       # one row per task
    if rows:
        model.calibrate(np.sum([r["sums"] for r in rows], axis=0))
    table.drop()
    return model


def loaded(shared, source):
    """The broadcast model with its parts; None if no language was learnt."""
    model = cloudpickle.loads(shared.value)
    if model is not None:
        model.source = source
    return model


def calibration_sums(shared, source):
    """The sums of ``Model.losses`` over a task's rows (l, _text) that have a letter."""
    def run(batches):
        symbols, model, total = Symbols(), loaded(shared, source), 0
        place = {x: j for j, x in enumerate(model.langs)}
        for batch in batches:
            langs, texts = column(batch, "l"), column(batch, "_text")
            for lo, hi in blocks(texts):
                ce, size, letter = model.entropies(texts[lo:hi], symbols)
                # a language without a text of its own n-grams is not learnt
                truth = np.array([place.get(x, -1) for x in langs[lo:hi]])
                on = letter & (truth >= 0)
                if on.any():
                    total = total + model.losses(ce[on], size[on], truth[on])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])
    return run


def predict(df: DataFrame, text: str, model: Parted | None, keep=()) -> DataFrame:
    """keep..., lang_pred, score, rejected of each row."""
    ship_by_value()
    spec = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))      # without its parts
    source = model.source if model is not None else []

    def run(batches):
        symbols, m = Symbols(), loaded(shared, source)
        for batch in batches:
            texts = [t or "" for t in column(batch, "_text")]
            for lo, hi in blocks(texts):
                pred, score, reject = np.full(hi - lo, "und", object), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                if m is not None:
                    ce, size, letter = m.entropies(texts[lo:hi], symbols)
                    best, s, r = m.judge(ce, size)
                    pred = np.where(letter, np.array(m.langs, object)[best], "und")
                    score, reject = np.where(letter, s, 0.0), r & letter
                kept = [batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(list(pred), pa.string()), pa.array(score), pa.array(reject)],
                                                 names=[*keep, "lang_pred", "score", "rejected"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, spec + "lang_pred string, score double, rejected boolean")
