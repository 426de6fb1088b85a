"""Operator 4: toxicity by a weighted lexicon.

Text and lexicon are folded alike, over all code points: compatibility forms
are taken apart (NFKD), accents, other marks and signs without a width go,
look-alike letters of other scripts and digits or signs that stand for letters
become plain letters, everything else becomes a space. An Aho-Corasick automaton finds the
lexicon's words and word beginnings; a hit inside an exception phrase does not
count; each word counts once with its largest weight. The sum of weights against
the length, and the sum itself, go through a logistic curve.

Entries, weights and curve are fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS``, the lowest hashes of the key, so the same rows on every run):
one half gives the lexicon (weights are smoothed log odds of words and word
beginnings in toxic against other texts) and the exception phrases (lexicon
words whose neighbour makes them harmless), the other half the curve.

Lexicon and exception phrases have at most MAX_ENTRIES entries each, those that
stand out most; the sample they come from is bounded too.

Defined results: null and empty texts score what the curve gives for no hits;
without labelled rows of both kinds the fixed lexicon and a fixed curve are
used; a score of exactly the threshold counts as toxic; repeated rows score
alike; texts of any length are measured whole, in time linear in them; all
columns, whatever their names, pass through ``without_toxic`` as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash60
from .texts import blocks, code_points, column, release, ship_by_value, worker_state

# A general lexicon, phrases in which a word of it is harmless,
# and the letters that look-alikes, digits and signs stand for.
LEXICON = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "bastard")
EXCEPTIONS = ("loser pays", "sore loser clause", "pond scum", "pathetic fallacy", "stupid question")
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
              "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ӏ": "l", "α": "a", "β": "b", "ε": "e",
              "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "l", "|": "l", "€": "e"}
SAME = {"l": "i"}           # 1 stands for both, so both fold to one letter

SAMPLE_ROWS = 20_000
MAX_ENTRIES = 5_000
BLOCK = 500_000             # characters worked on at once
PREFIXES = (4, 5, 6, 7)     # lengths of word beginnings
MIN_G2 = 27.0               # log-likelihood ratio that an entry needs
MIN_ODDS = math.log(6)
MORE_THAN_WORD = 1.3        # texts with a word beginning against those with its commonest word
FIXED_WEIGHT = 4.0
FIXED_CURVE = (-4.0, 1.5, 0.5)
LETTERS_END = 0x20000       # beyond: ideographs up to LAST_LETTER, else no letters
LAST_LETTER = 0x40000
TAGS = range(0xE0000, 0xE1000)      # signs without a width


def fold_char(c: str) -> str:
    """A code point of a decomposed text: '' for marks and signs without a width,
    a space for what is no letter."""
    if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf"):
        return ""
    c = c.lower()[0]
    c = LOOKALIKES.get(c, SIGNS.get(c, c))
    return SAME.get(c, c) if c.isalpha() else " "


def fold_table() -> np.ndarray:
    """Code point -> folded code point; 0 where it goes."""
    out = np.full(0x110000, 32, np.uint32)
    out[:LETTERS_END] = [ord(fold_char(chr(cp)) or "\0") for cp in range(LETTERS_END)]
    out[LETTERS_END:LAST_LETTER] = np.arange(LETTERS_END, LAST_LETTER)
    out[TAGS.start:TAGS.stop] = 0
    return out


def decomposed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKD", text)


def folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, and the start of each (one more than texts)."""
    cps, starts = code_points([decomposed(t) for t in texts])
    out = table[cps]
    keep = out != 0
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def fold(text: str, table: np.ndarray) -> str:
    return folded([text], table)[0].tobytes().decode("utf-32-le", "surrogatepass")


def fold_word(word: str) -> str:
    return "".join(map(fold_char, decomposed(word)))


def automaton(model: dict):
    """Entries begin at a word's beginning; whole words end in a space too."""
    a = ahocorasick.Automaton()
    for entry, weight in model["entries"].items():
        a.add_word(" " + entry, (weight, len(entry.rstrip())))
    for phrase in model["exceptions"]:
        a.add_word(" " + phrase + " ", (None, len(phrase)))
    a.make_automaton()
    return a


def measure(texts: list[str], model: dict, table: np.ndarray, a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, hits and words of each text."""
    total, hits, words = (np.zeros(len(texts)) for _ in range(3))
    for lo, hi in blocks(texts, BLOCK):
        # a space before and after every text, so no word spans two of them
        signs, starts = folded([" " + t + " " for t in texts[lo:hi]], table)
        letter = signs != 32
        begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        words[lo:hi] = np.bincount(np.searchsorted(starts, begin, side="right") - 1, minlength=hi - lo)[:hi - lo]
        if not len(a):
            continue
        at, weight, skip = [], [], []
        for end, (w, n) in a.iter(signs.tobytes().decode("utf-32-le", "surrogatepass")):
            if w is None:
                skip.append((end - n, end))
            else:
                # the entry ends at ``end``, or in the space behind its word
                stop = end if letter[end] else end - 1
                at.append(stop - n + 1)
                weight.append(w)
        if not at:
            continue
        at, weight = np.array(at), np.array(weight)
        if skip:
            order = np.argsort(at, kind="stable")
            first, last = (np.searchsorted(at[order], x) for x in zip(*skip))
            inside = np.zeros(len(at) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, last, -1)
            weight[order[np.cumsum(inside)[:-1] > 0]] = 0
        place, inv = np.unique(at, return_inverse=True)
        best = np.zeros(len(place))
        np.maximum.at(best, inv, weight)
        doc = np.searchsorted(starts, place, side="right") - 1
        total[lo:hi] = np.bincount(doc, best, minlength=hi - lo)
        hits[lo:hi] = np.bincount(doc, best > 0, minlength=hi - lo)
    return total, hits, words


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Constant, weight against length, weight."""
    return np.stack([np.ones_like(total), np.log1p(100 * total / np.maximum(words, 20)), np.log1p(total)], axis=1)


def count_terms(df: DataFrame, label: str, text: str) -> DataFrame:
    """Texts of each label that hold a term: a whole word (ends in a space) or a
    word beginning."""
    ship_by_value()

    def run(batches):
        table = worker_state("toxicity fold", fold_table)
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for t, y in zip(column(batch, text), column(batch, label)):
                seen = set(fold(t or "", table).split())
                terms = {w + " " for w in seen}
                for n in PREFIXES:
                    terms.update(w[:n] for w in seen if len(w) > n)
                counts[int(y)].update(terms)
            for y, c in counts.items():
                if c:
                    yield pa.RecordBatch.from_pydict({"term": list(c), "y": [y] * len(c), "n": list(c.values())},
                                                     schema=pa.schema([("term", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))
    return df.select(F.col(label).alias(label), F.col(text).alias(text)).mapInArrow(run, "term string, y int, n bigint")


def lexicon(counts: DataFrame, bad: int, good: int) -> dict[str, float]:
    """At most MAX_ENTRIES terms whose share of toxic texts stands out."""
    a, b = F.col("a"), F.col("b")
    t = counts.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
                                   F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
    all_n = float(bad + good)
    part = lambda x, side: F.when(x > 0, x * F.log(x * all_n / ((a + b) * float(side)))).otherwise(0.0)
    g2 = 2 * (part(a, bad) + part(b, good))
    t = t.filter(a >= 2).withColumn("odds", odds).withColumn("g2", g2).filter((F.col("odds") >= MIN_ODDS) & (F.col("g2") >= MIN_G2))
    top = t.orderBy(F.desc("g2"), "term").limit(MAX_ENTRIES).collect()
    # a word beginning is kept only if it stands for more than one word
    most = Counter()
    for r in top:
        if r["term"].endswith(" "):
            for n in PREFIXES:
                most[r["term"][:n]] = max(most[r["term"][:n]], r["a"])
    return {r["term"]: float(r["odds"]) for r in top
            if r["term"].endswith(" ") or r["a"] >= MORE_THAN_WORD * most[r["term"]]}


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, halved until the loss falls, with a
    small ridge (the classes may be separable)."""
    ridge = np.array([1e-6] + [1e-2] * (x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (ridge * w * w).sum() / 2
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-8 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def harmless(df: DataFrame, label: str, text: str, entries: dict[str, float]) -> list[str]:
    """Two-word phrases with a lexicon word that only texts of label 0 hold."""
    ship_by_value()
    whole = {e.strip() for e in entries if e.endswith(" ")}

    def run(batches):
        table = worker_state("toxicity fold", fold_table)
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for t, y in zip(column(batch, text), column(batch, label)):
                ws = fold(t or "", table).split()
                hit = [i for i, w in enumerate(ws) if w in whole]
                counts[int(y)].update({" ".join(ws[j:j + 2]) for i in hit for j in (i - 1, i) if j >= 0 and j + 2 <= len(ws)})
            for y, c in counts.items():
                if c:
                    yield pa.RecordBatch.from_pydict({"term": list(c), "y": [y] * len(c), "n": list(c.values())},
                                                     schema=pa.schema([("term", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))
    pairs = df.select(label, text).mapInArrow(run, "term string, y int, n bigint")
    t = pairs.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
                                  F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    return [r["term"] for r in t.filter("a = 0 and b >= 5").orderBy(F.desc("b"), "term").limit(MAX_ENTRIES).collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from documents (key, text) and labels (key, 0 or 1): entries,
    exceptions, curve. The sample is drawn from the keys; texts of other rows are
    not shuffled."""
    entries = {fold_word(w) + " ": FIXED_WEIGHT for w in LEXICON}
    exceptions = [fold_word(p) for p in EXCEPTIONS]
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    ids = (known.join(docs.select(F.col(key).alias("_k")), "_k", "left_semi").groupBy("_k").agg(F.max("_y").alias("_y"))
           .withColumn("_h", hash60("toxicity", "_k")).orderBy("_h", "_k").limit(sample_rows))
    some = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(F.broadcast(ids), F.col("_key") == F.col("_k"))
            .select(F.col("_t").alias(text), F.col("_y").alias(label), "_h").persist())
    halves = [some.filter(F.col("_h") % 2 == i) for i in (0, 1)]
    n = {r[label]: r["count"] for r in halves[0].groupBy(label).count().collect()}
    if n.get(0) and n.get(1):
        learnt = lexicon(count_terms(halves[0], label, text), n[1], n[0])
        entries.update(learnt)
        exceptions += harmless(halves[0], label, text, entries)
    model = {"entries": entries, "exceptions": exceptions, "curve": FIXED_CURVE}
    rows = measured(halves[1], text, model, keep=(label,)).select(label, "total", "words").collect()     # half the sample
    some.unpersist()
    y = np.array([r[0] for r in rows], float)
    if len(rows) >= 50 and 0 < y.sum() < len(y):
        model["curve"] = fit_curve(features(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), y)
    return model


def measured(df: DataFrame, text: str, model: dict, keep=()) -> DataFrame:
    """keep..., total, hits, words, score of each row."""
    ship_by_value()
    schema = df.select(*keep).schema
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", total double, hits double, words double, score double"

    def run(batches):
        table, a = worker_state("toxicity fold", fold_table), automaton(model)
        for batch in batches:
            texts = [t or "" for t in column(batch, "_text")]
            total, hits, words = measure(texts, model, table, a)
            score = 1 / (1 + np.exp(-np.clip(features(total, words) @ np.array(model["curve"]), -30, 30)))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (total, hits, words, score))],
                                             names=[*keep, "total", "hits", "words", "score"])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, spec)


def without_toxic(df: DataFrame, text: str, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose score is under the threshold."""
    ship_by_value()

    def run(batches):
        table, a = worker_state("toxicity fold", fold_table), automaton(model)
        for batch in batches:
            total, _, words = measure([t or "" for t in column(batch, text)], model, table, a)
            score = 1 / (1 + np.exp(-np.clip(features(total, words) @ np.array(model["curve"]), -30, 30)))
            yield batch.filter(pa.array(score < threshold))
        release()           # the next stage needs the memory
    return df.mapInArrow(run, df.schema)


def fold_number(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % parts
