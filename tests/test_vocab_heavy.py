import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborform.operators.heavy import frequent, pruned, summaries
from arborform.operators.vocab import build_vocab, build_vocab_frequent


def _tokens(spark, seed, kinds=3000, n=30_000):
    rnd = random.Random(seed)
    words = [f"w{int(kinds * rnd.random() ** 3)}" for _ in range(n)]
    return words, spark.createDataFrame([(w,) for w in words], "token string").repartition(4)


def test_pruned_keeps_the_bound():
    counts = {"a": 9, "b": 5, "c": 5, "d": 2, "e": 1}
    kept, off = pruned(counts, 3)
    assert (kept, off) == ({"a": 7, "b": 3, "c": 3}, 2)
    assert all(kept.get(t, 0) <= n <= kept.get(t, 0) + off for t, n in counts.items())
    assert pruned(counts, 9) == (counts, 0)


def test_summaries_bound_every_count(spark):
    words, df = _tokens(spark, 1)
    rows = summaries(df, "token", 50).collect()
    error = sum(r.n for r in rows if r.token is None)
    low = Counter()
    for r in rows:
        if r.token is not None:
            low[r.token] += r.n
    true = Counter(words)
    assert error > 0 and all(low[t] <= true[t] <= low[t] + error for t in true)


@pytest.mark.parametrize("counters, size", [(None, 100), (200, 100), (60, 20), (2, 5)])
def test_exact_whatever_the_counters(spark, counters, size):
    """Small summaries prove too little at first and are made anew."""
    words, df = _tokens(spark, 2)
    true = Counter(words)
    want = sorted(true, key=lambda t: (-true[t], t))[:size]
    got = {r.token: r.n for r in frequent(df, size, counters=counters).collect()}
    assert set(want) <= set(got) and all(got[t] == true[t] for t in got)
    last = true[want[-1]]
    assert {t for t in true if true[t] == last} <= set(got)          # ties
    v = {r.id: r.token for r in build_vocab_frequent(df, size, counters=counters).collect()}
    assert [v[5 + i] for i in range(size)] == want


def test_equally_rare_tokens_are_counted_plainly(spark):
    df = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("token")).repartition(2)
    assert frequent(df, 50, counters=10, most=300) is None
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(build_vocab_frequent(df, 50), build_vocab(df, 50))


def test_few_null_and_blank_tokens(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (" ",), ("<s>",), ("b",)], "token string")
    got = {r.token: r.id for r in build_vocab_frequent(df, 10).collect()}
    assert (got["a"], got["b"], got["<s>"], len(got)) == (5, 6, 0, 7)
    assert build_vocab_frequent(df.limit(0), 10).count() == 5


def test_tokens_are_filtered_after_they_are_counted(spark, monkeypatch):
    """Whether a token can enter is asked of the counts read back, not of every occurrence."""
    from arborform.operators import vocab
    seen, kept = [], vocab.written

    def noted(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)
    monkeypatch.setattr(vocab, "written", noted)
    rows = spark.createDataFrame([("a",), ("a",), (" ",), ("<s>",), (None,), ("b",)], "token string")
    out = {r.token: r.id for r in vocab.build_vocab(rows, 10).collect()}
    assert out["a"] == 5 and out["b"] == 6 and len(out) == 7
    assert seen and "trim" not in seen[0]
