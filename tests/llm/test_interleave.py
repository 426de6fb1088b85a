import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from arborform.llm.interleave import SEED, add_shards, interleave


def h(key):
    return int(hashlib.md5(f"{SEED}:{key}".encode()).hexdigest()[:15], 16)


def brute(rows, shards):
    by = {}
    for k, s in rows:
        by.setdefault(s, []).append((h(k), k))
    order = []
    for s, ks in by.items():
        ks.sort()
        order += [((2 * i + 1) / (2 * len(ks)), s is None, s or "", x, k) for i, (x, k) in enumerate(ks)]
    order.sort()
    n, out = len(order), {}
    for g, (*_, k) in enumerate(order):
        shard = g * shards // n
        out[k] = (shard, g - -(-shard * n // shards))
    return out


def test_equals_brute_force(spark):
    rows = [(i, None if i % 17 == 0 else f"s{i % 5}" if i % 3 else "hot") for i in range(1500)]
    df = spark.createDataFrame(rows, "k bigint, source string")
    got = {r["k"]: (r["shard"], r["slot"]) for r in interleave(df, "k", "source", 7).collect()}
    assert got == brute(rows, 7)


def test_counts_slots_and_mixture(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"))
    out = interleave(df, "k", "source", 40, carry=("source",)).collect()
    size = Counter(r["shard"] for r in out)
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= 1
    for shard in range(40):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(size[shard]))
    for s in {r["source"] for r in out}:
        per = Counter(r["shard"] for r in out if r["source"] == s)
        total = sum(per.values())
        assert all(abs(per[i] - total / 40) <= 2 for i in range(40))


def test_more_shards_than_rows_ties_nulls_and_clashes(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "x"), (None, None, None), (None, None, None), (2, "b", "")]
    df = spark.createDataFrame(rows, "key bigint, source string, h string").withColumn("f", F.lit(1)).withColumn("shard", F.lit(99)).withColumn("g", F.lit("g"))
    out = interleave(df, "key", "source", 40, carry=("h", "f", "g")).collect()
    assert len(out) == 6 and len({r["shard"] for r in out}) == 6 and {r["slot"] for r in out} == {0}
    wide = add_shards(df, "key", "source", 40, "h")
    assert sorted(wide.columns) == sorted(df.columns)
    assert sorted(r["shard"] for r in wide.collect()) == sorted(r["shard"] for r in out)


def test_wide_rows_get_the_same_shards(spark):
    df = (spark.range(700).select((F.col("id") % 400).alias("k"), F.when(F.col("id") % 400 < 150, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
          .withColumn("text", F.concat(F.lit("text "), F.col("k"))).withColumn("source", F.when(F.col("k") % 2 == 0, "a").otherwise((F.col("k") % 5).cast("string"))))
    narrow = Counter((r["k"], r["shard"]) for r in interleave(df, "k", "source", 40, tie=F.xxhash64("text")).collect())
    wide = Counter((r["k"], r["shard"]) for r in add_shards(df, "k", "source", 40, "text").collect())
    assert narrow == wide and sum(wide.values()) == 700


def test_empty_table(spark):
    df = spark.createDataFrame([], "k bigint, source string, text string")
    assert interleave(df, "k", "source", 40).count() == 0
    assert add_shards(df, "k", "source", 40, "text").count() == 0


def test_query_sizes_and_checksums(spark, tmp_path):
    from arborform.llm.queries import queries
    rows = [(1, None, "a"), (2, "", None), (3, "é𝒳" * 40_000, "a"), (4, "x", "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries()["op7_interleave"](spark, str(tmp_path)).collect()}
    for k, t, _ in rows:
        raw = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
