"""Plan checks: the physical plans have the shape the operators promise."""

import os

import pytest
from pyspark.sql import functions as F

from arborform.operators import metrics, splits
from arborform.plans import catalog as C

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables missing")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_broadcast_vocab_and_one_exchange_by_key(spark):
    p = plan(C.feature_frame(spark, SF))
    assert "BroadcastHashJoin" in p
    # the walk side is shuffled once, by document key; the grouping reuses it
    # (the vocabulary's counts were written before)
    assert p.count("hashpartitioning(doc_id") == 1
    assert "SortMergeJoin" not in p


def test_features_of_an_input_that_is_not_spread(spark):
    from arborform.operators import sequence as seq
    src = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab = spark.createDataFrame([("the", 5)], "token string, id int")
    p = plan(seq.features(src, vocab, "doc_id", "text", 32, vocab_rows=1))
    assert p.count("hashpartitioning(doc_id") == 1 and "SortMergeJoin" not in p     # leaf rows, before grouping


def test_pair_features_scan_the_texts_once_more_only(spark):
    p = plan(C.pair_frame(spark, SF))
    assert p.count("documents.parquet") <= 3
    assert not any("text" in x.split("\n")[0] and "hashpartitioning(pair_id" in x for x in p.split("Exchange"))


def test_vector_lookups_are_broadcast(spark):
    p = plan(C.token_vectors(spark, SF))
    assert p.count("BroadcastHashJoin") >= 6          # vocabulary + five vector sources
    assert "SortMergeJoin" not in p


def test_half_split_and_batches_avoid_single_partition_windows(spark):
    df = C.doc_keys(spark, SF).select("doc_id")
    p = plan(splits.half_split(df, "doc_id", 1))
    assert "Window" not in p and "SinglePartition" not in p
    p = plan(metrics.batch_ids(df, "doc_id", 32))
    assert "Window" not in p.split("BroadcastExchange")[0]      # a window over one row per partition only


def test_layout_walk_is_map_only(spark):
    p = plan(C.q_layout_leaves(spark, SF))
    # only the exchange that spreads a single-row-group file over the cores
    assert p.count("Exchange") <= 1 and "Window" not in p and "Aggregate" not in p


def test_exclude_lang_is_pushed_to_the_scan(spark):
    p = plan(C.q_exclude_lang(spark, SF))
    assert "PushedFilters: [Not(EqualNullSafe(lang,es))]" in p
    assert "text" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_vocab_over_the_bound_is_not_broadcast(spark, monkeypatch):
    from arborform.operators import common
    from arborform.operators.vocab import to_ids
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, token string")
        vocab = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "token string, id int")
        small = plan(to_ids(rows, vocab))                       # 3 rows: checked, broadcast
        assert "BroadcastHashJoin" in small
        monkeypatch.setattr(common.broadcast_under, "__defaults__", (None, 2 * 64))
        over = to_ids(rows, vocab)                              # over the bound in bytes
        assert "BroadcastHashJoin" not in plan(over) and "SortMergeJoin" in plan(over)
        assert sorted(r.id for r in over.collect()) == [5, 6]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
