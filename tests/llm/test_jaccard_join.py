import pickle
import random
import re
import zlib

import numpy as np
import pytest

from arborform.llm import jaccard_join as J


def sets(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows):
    s = {k: sets(t) for k, t in rows}
    up = {k: k for k in s}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(s[k]), top(k)) for k in s}


def run(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(3)
    return {r["key"]: (r["n"], r["component"]) for r in J.similar(df, "k", "t").collect()}


def corpus(seed, docs=140):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = rnd.choices(vocab, k=60)
    rows = []
    for i in range(docs):
        kind = rnd.random()
        if rows and kind < 0.45:                        # chains and stars of near copies
            ws = (rnd.choice(rows)[1] or "").split(" ")
            for _ in range(rnd.randint(0, 3)):
                if ws:
                    p = rnd.randrange(len(ws))
                    ws[p:p + 1] = rnd.choice([[rnd.choice(vocab)], [], [ws[p], "NEW"]])
            rows.append((i, " ".join(ws)))
        elif kind < 0.6:                                # a common passage and little else
            rows.append((i, " ".join(passage + rnd.choices(vocab, k=rnd.randint(0, 40)))))
        else:
            rows.append((i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 4, 5, 6, 30, 120])))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_exact_without_frequencies(spark, monkeypatch):
    """Any order is right: with frequency cells that are all alike the prefixes
    are by hash, groups are large, and the result stays exact."""
    monkeypatch.setattr(J, "frequencies", lambda docs, text: pickle.dumps((0, {0: zlib.compress(b"\x04" * (1 << J.CELL_BITS))})))
    rows = corpus(5, 90)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "A\tB"), (6, "a b c d e"), (7, "a b c d e f"),
            (8, long), (9, long + " end"), (10, "É b"), (11, "é b"), (12, "x\x1cy")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[5] == (1, 4) and got[9][1] == 8 and got[10][1] == 10 and got[3] == (0, 3)


def test_repeated_and_null_keys_and_clashes(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t, 1), (None, t, 1), (7, t, 2), (7, t, 3), (None, "alone with no friend at all", 4), (9, "", 5), (9, "", 6)],
                               "key bigint, text string, comp int")
    out = sorted(((r["key"], r["n"], r["component"]) for r in J.similar(df, "key", "text").collect()), key=str)
    assert out == sorted([(7, 3, 7), (7, 3, 7), (9, 0, 9), (9, 0, 9), (None, 3, 7), (None, 3, 7), (None, 2, None)], key=str)
    kept = sorted((r["key"], r["comp"]) for r in J.one_of_each(df, "key", "text").fillna(-1).collect())
    assert kept in ([(-1, 4), (7, 2), (9, 5), (9, 6)], [(-1, 4), (7, 3), (9, 5), (9, 6)])
    assert J.one_of_each(df, "key", "text").columns == df.columns


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_large_group_makes_few_pairs(spark):
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        ws = list(base)
        ws[(i * 7) % 200] = f"x{i}"
        rows.append((i, " ".join(ws)))
    got = run(spark, rows)
    assert {c for _, c in got.values()} == {0}


def test_parities_never_exclude_a_link():
    """Bits that differ are at most the shingles that one set has and the other lacks."""
    rnd = random.Random(11)
    for _ in range(300):
        a = rnd.choices([f"w{i}" for i in range(4000)], k=rnd.choice([5, 40, 300, 3000]))
        b = list(a)
        for _ in range(rnd.choice([0, 1, 3, 30])):
            b[rnd.randrange(len(b))] = rnd.choice(["new", "words"])
        h, n = J.shingles([" ".join(a), " ".join(b)], J.Powers())
        x, y = J.parities(h, n, [0, 1])
        assert len(x) * 64 == J.PARITY_BITS
        differ = sum(bin((int(p) ^ int(q)) & ((1 << 64) - 1)).count("1") for p, q in zip(x, y))
        s, t = sets(" ".join(a)), sets(" ".join(b))
        assert differ <= len(s ^ t) and (len(s ^ t) - differ) % 2 == 0
        if 100 * len(s & t) >= 80 * len(s | t):
            assert differ * 9 <= len(s) + len(t)


def test_group_below_the_threshold_makes_few_rows(spark):
    """Copies that come near the threshold without reaching it: no pair is made of them."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):
        ws = list(base)
        for p in rnd.sample(range(0, 300, 6), 9):       # each copy: 45 of 296 shingles are its own
            ws[p] = f"x{i}-{p}"
        rows.append((i, " ".join(ws)))
    assert len(set(run(spark, rows).values())) == len(rows)
    df = spark.createDataFrame(rows, "k bigint, t string")
    shared = spark.sparkContext.broadcast(J.frequencies(df, "t"))
    classes = J.signed(df, "k", "t", shared).selectExpr("key as c", "n", "m", "w", "tokens", "bits")
    entries = classes.selectExpr("c", "c as comp", "n", "m", "w", "posexplode(tokens) as (i, token)").selectExpr("c", "comp", "n", "m", "i", "token", "w - i as r")
    assert entries.count() > 2000 and J.cross_pairs(entries, classes).count() == 0


def test_prefix_keeps_enough():
    v = np.array([0, 0, 8, 8, 8, 8, 8, 8, 20, 40])
    m, size = J.prefix_of(v, 10)
    assert 1 <= m <= J.MAX_MATCHES and size == 10 - 8 + m
    assert J.prefix_of(np.zeros(50), 50) == (1, 11)


def test_hash_sets_have_the_size_of_word_sets():
    texts = [t for _, t in corpus(9)] + [None, "ÄÖ ü\x0bA b C d"]
    _, n = J.shingles(texts, J.Powers())
    assert n.tolist() == [len(sets(t)) for t in texts]
