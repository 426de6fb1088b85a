import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborform.llm.spelling import ALPHABET, Words, corpus_words, variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(counts):
    v = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * v[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, v[w], len(near[w]), form[w], v.get(form[w]), root(w)) for w in v)


def rows(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def random_counts(seed, n=600):
    rnd = random.Random(seed)
    out = Counter()
    for _ in range(n):
        w = "".join(rnd.choices("abéz", k=rnd.randint(4, 7)))
        out[w] += rnd.choice([1, 3, 3, 4, 7, 20, 90])
    return out


@pytest.mark.parametrize("seed, blocks", [(1, 1 << 21), (2, 40), (3, 7)])
def test_equals_brute_force_in_one_or_many_waves(spark, seed, blocks):
    counts = random_counts(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows(variants(df, blocks)) == brute(counts)


def test_edits_are_each_pair_once():
    """Hashes of all edits of both words hold the other's hash exactly once."""
    rnd = random.Random(5)
    for _ in range(300):
        a = "".join(rnd.choices(ALPHABET[:3] + ALPHABET[-2:], k=rnd.randint(1, 6)))
        i = rnd.randrange(len(a))
        b = rnd.choice([a[:i] + a[i + 1:], a[:i] + rnd.choice(ALPHABET) + a[i + 1:], a[:i] + rnd.choice(ALPHABET) + a[i:]])
        w = Words([a, b])
        h = w.hashes()
        hits = sum(int(((x == h[1 - word[0]]) & (word == word[0])).sum()) if len(set(word.tolist())) == 1 else
                   sum(int(h[1 - k] == y) for k, y in zip(word.tolist(), x.tolist())) for word, _, x in w.edits())
        assert hits == (1 if a != b else 0), (a, b)


def test_noise_rule_and_odd_rows(spark):
    texts = [(i, f"Straße word{i} anblew anblew ANBLEW ×÷ÀÿX don't") for i in range(150)]
    texts += [(None, "anblew"), (7, None), (8, ""), (9, "x" * 50_000), (9, "x" * 50_000), (9, "x" * 49_999 + "y")]
    want = Counter()
    for k, t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("c"))
    got = corpus_words(df, "doc_id", "text", noise=97)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert rows(variants(got)) == brute(want)


def test_very_long_words_and_empty_tables(spark):
    long = "ab" * 20_000
    df = spark.createDataFrame([(long, 9), (long[1:], 3), (long[:-1] + "c", 4), ("short", 2)], "word string, n bigint")
    assert rows(variants(df)) == brute({long: 9, long[1:]: 3, long[:-1] + "c": 4, "short": 2})
    assert variants(df.limit(0)).count() == 0
    assert variants(spark.createDataFrame([("alone", 3)], "word string, n bigint")).collect()[0]["root"] == "alone"
