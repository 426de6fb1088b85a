from collections import Counter

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage over the small tables."""
    from arborform.llm.common import scratch
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        new = scratch(stage(spark, docs, sf), "test-stage")
        out.append((name, docs, new))
        docs = new
    return {n: (a, b) for n, a, b in out}


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(stages):
    names = list(stages)
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    for n in names[:-1]:
        assert stages[n][0].columns == stages[n][1].columns


def test_toxicity_equals_the_scores(spark, sf, stages):
    from arborform.llm.toxicity import fit, fold_number, measured
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(fold_number("doc_id", 5) != 0)
    m = fit(before, labels, "doc_id", "text", "toxic")
    want = [r["doc_id"] for r in measured(before, "text", m, keep=("doc_id",)).filter("score < 0.5").collect()]
    assert sorted(ids(after)) == sorted(want)


def test_one_of_each_group_stays(stages):
    from test_jaccard_join import brute
    before, after = stages["near duplicates"]
    comp = brute([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
    assert sorted(ids(after)) == sorted({c for _, c in comp.values()})


def test_no_passage_stays_and_clean_ones_do(spark, sf, stages):
    before, after = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in before.collect() if any(i in r["text"] for i in items)}
    assert sorted(ids(after)) == sorted(set(ids(before)) - dirty)


def test_mix_repeats_whole_rows(stages):
    before, after = stages["mixing"]
    times = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert times <= 2 and after.join(before, before.columns, "left_anti").count() == 0


def test_shards_are_even(stages):
    before, after = stages["sharding"]
    assert sorted(ids(before)) == sorted(ids(after))
    n = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert max(n) - min(n) <= 1 and len(n) == 40


def test_run_equals_the_stages(spark, sf, stages):
    out = cp.run(spark, sf)
    last = stages["sharding"][1]
    assert sorted(map(tuple, out.select("doc_id", "shard").collect())) == sorted(map(tuple, last.select("doc_id", "shard").collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, "en", "a", 1), (1, None, "en", "a", 1), (2, "", None, None, 2), (None, "some words", "en", "a", 3), (3, "word " * 30_000, "de", "b", 4),
            (4, "a b c d e f", "en", "b", 5), (5, "a b c d e f", "en", "b", 5)]
    spec = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = str(tmp_path)
    spark.createDataFrame(rows, spec).withColumn("shard", F.lit("old")).withColumn("key", F.lit(1)).withColumn("h", F.lit(2)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "nothing that anybody holds in a text")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = cp.run(spark, d)
    # 5 is a copy of 4; source a (2 words) is taken twice, b (30,006 words) once and, of the rest, its document
    # that comes nearest to it again; the null source has no words and no target
    assert Counter(r["doc_id"] for r in out.collect()) == {1: 4, None: 2, 3: 1, 4: 2}
    assert {"shard", "key", "h", "lang", "n_chars"} <= set(out.columns)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0
