from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborform.llm.common import word_count
from arborform.llm.mixing import BUDGET, CAP, WEIGHTS, mix, plan, keyed, place, targets


def fill(sizes, weights=WEIGHTS, budget=BUDGET, cap=CAP):
    """Resharing round by round, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, None: 30}, {"a": 10, "b": 1000, "c": 20, "d": 5, "é": 400}, {"a": 7}, {"a": 0, "b": 9}, {"a": 0}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in targets(df).collect()}
    want = fill(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def docs(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
                                 F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 40).cast("int") + 1), " ").alias("t"))


def test_words_near_targets_and_shard_quotas(spark):
    df = docs(spark)
    rows = keyed(df, "k", "source", word_count("t"))
    sources, blocks = plan(rows, shards=8)
    out = place(rows, sources, blocks).collect()
    assert len(out) == 2000
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        taken = sum(r["size"] * len(r["copies"]) for r in own)
        assert abs(taken - own[0]["target"]) <= 20 and max(len(r["copies"]) for r in own) <= 2
    # the tree decides: with another number of shards other documents fill the rest of the targets
    other = {r["key"]: len(r["copies"]) for r in place(rows, *plan(rows, shards=3)).collect()}
    assert sum(other[r["key"]] != len(r["copies"]) for r in out) > 20
    # block quotas: shards hold equal numbers of block slots, sources drawn hypergeometrically
    slots = Counter(h["shard"] for b in blocks.collect() for h in b["homes"])
    assert len(slots) == 8 and max(slots.values()) - min(slots.values()) <= 3
    again = {(r["key"], tuple(r["copies"])) for r in place(rows, *plan(rows, shards=8)).collect()}
    assert again == {(r["key"], tuple(r["copies"])) for r in out}


def test_mixed_rows_are_the_copies(spark):
    df = docs(spark, 600).withColumn("h", F.lit("clash")).withColumn("_block", F.lit(1))
    rows = keyed(df, "k", "source", word_count("t"))
    want = Counter()
    for r in place(rows, *plan(rows)).collect():
        want.update((r["key"], s) for s in r["copies"])
    out = mix(df, "k", "source", word_count("t"))
    assert out.columns == [*df.columns, "_shard", "_key"]
    assert Counter((r["k"], r["_shard"]) for r in out.collect()) == want


def test_hypergeometric_counts(spark):
    """Over many seeds a shard's count of a source has the hypergeometric mean
    and variance."""
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", 1) for i in range(800)], "key bigint, source string, size bigint")
    from arborform.llm.common import hash60
    counts = []
    for seed in range(6):
        rows = df.withColumn("h", hash60(seed, "key"))
        _, blocks = plan(rows, shards=4, seed=seed, weights=(1.0,), budget=1.0, cap=1.0)
        per = Counter((h["shard"], b["source"]) for b in blocks.collect() for h in b["homes"])
        counts += [per[i, "b"] for i in range(4)]
        quota = sum(per[i, "b"] for i in range(4))
        assert abs(sum(per[i, "b"] for i in range(4)) / 4 - quota / 4) < 1e-9
    mean = sum(counts) / len(counts)
    var = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert 0 < var < 80


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 100_000, "a"), (3, "x " * 100_000, "a"), (None, "a b c", None), (None, "a b c", None)]
    df = spark.createDataFrame(rows, "k bigint, t string, source string")
    n = keyed(df, "k", "source", word_count("t"))
    out = place(n, *plan(n)).collect()
    assert len(out) == 6 and all(len(r["copies"]) <= 2 for r in out)
    assert sorted(r["size"] for r in out) == [0, 0, 3, 3, 100_000, 100_000]
    e = df.filter("k > 9")
    assert mix(e, "k", "source", word_count("t")).count() == 0
