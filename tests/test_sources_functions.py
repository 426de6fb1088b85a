import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from arborform.functions.table_functions import LEAF_ARRAYS, LeafArrays, register_walk
from arborform.operators.shape import exclude_lang
from arborform.operators.trees import layout_leaves, leaf_arrays
from arborform.sources.json_splits import matches, read_json_splits, write_json_splits

SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture()
def corpus(spark, tmp_path):
    rows = [(i, f"text {i}\nü", ["en", "es", None][i % 3], ["train", "test"][i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, split string")
    return rows, write_json_splits(df.repartition(3), str(tmp_path / "c"))


def filters(df):
    """Filter nodes that Spark evaluates itself."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in lines if re.match(r"[\s:+\-*()\d]*Filter ", x)]


def got(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["split"]) for r in df.collect())


def test_one_split_is_read_with_filters_pushed(spark, corpus):
    rows, path = corpus
    assert got(read_json_splits(spark, path, SCHEMA)) == sorted(rows)
    one = read_json_splits(spark, path, SCHEMA, "test")
    assert got(one) == sorted(r for r in rows if r[3] == "test")
    # the filter is the reader's: Spark keeps none, and no task opens a file of the other split
    assert not filters(one)
    assert one.rdd.getNumPartitions() == len([f for f in os.listdir(f"{path}/split=test") if f.endswith(".gz")])
    # missing languages stay when one is left out
    assert got(exclude_lang(one, "es")) == sorted(r for r in rows if r[3] == "test" and r[2] != "es")
    assert got(one.filter("lang in ('es', 'en') and doc_id > 9")) == sorted(r for r in rows if r[3] == "test" and r[2] and r[0] > 9)
    assert filters(one.filter("doc_id > 9"))
    assert got(one.filter("lang <> 'es'")) == sorted(r for r in rows if r[3] == "test" and r[2] == "en")
    assert read_json_splits(spark, path, SCHEMA, "none").count() == 0


def test_comparisons_are_those_of_sql():
    assert [matches("=", "a", v) for v in ("a", "b", None)] == [True, False, None]
    assert [matches("<=>", "a", v) for v in ("a", "b", None)] == [True, False, False]
    assert matches("<=>", None, None) is True and matches("in", ("a", "b"), "b") is True and matches("in", ("a",), None) is None
    assert [matches("is not null", None, v) for v in ("a", None)] == [True, False]


def test_odd_lines(spark, tmp_path):
    d = tmp_path / "o" / "split=a%20b"
    os.makedirs(d)
    with gzip.open(d / "x.json.gz", "wt", encoding="utf-8") as f:
        f.write(json.dumps({"doc_id": 1, "extra": 5}) + "\n\n" + json.dumps({"doc_id": 2, "text": "𝒳" * 50_000, "split": "other"}) + "\n{broken\n")
    path = str(tmp_path / "o")
    rows = read_json_splits(spark, path, SCHEMA, "a b", broken="skip").collect()
    assert [(r.doc_id, r.text and len(r.text), r.lang, r.split) for r in rows] == [(1, None, None, "a b"), (2, 50_000, None, "a b")]
    with pytest.raises(Exception, match="no JSON in line 4"):
        read_json_splits(spark, path, SCHEMA).collect()
    with pytest.raises(Exception, match="not s3"):
        read_json_splits(spark, "s3://bucket/x", SCHEMA).collect()


def test_walk_from_sql_equals_leaf_arrays(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, None), (4, "x " * 300)], "doc_id bigint, text string")
    leaves = layout_leaves(docs, "doc_id", "text")
    leaves.orderBy(F.desc("leaf_pos")).createOrReplaceTempView("leaves")
    register_walk(spark, "walk_leaves", LeafArrays, LEAF_ARRAYS)
    walked = spark.sql("SELECT * FROM walk_leaves(TABLE(leaves) PARTITION BY doc_id ORDER BY leaf_pos)")
    want = leaf_arrays(leaves, "doc_id").select(*walked.columns)
    assert sorted(map(str, walked.collect())) == sorted(map(str, want.collect())) and walked.count() == 4


def test_a_walk_of_many_rows_a_group(spark):
    class Gaps:
        """Every gap between two ordered values of a group, and their number at the end."""

        def __init__(self):
            self.last, self.n = None, 0

        def row(self, row):
            if self.last is not None:
                yield row["k"], row["v"] - self.last
                self.n += 1
            self.last, self.k = row["v"], row["k"]

        def end(self):
            if self.last is not None:
                yield self.k, -self.n
    spark.createDataFrame([(1, 9), (1, 2), (1, 4), (2, 7)], "k int, v int").repartition(3).createOrReplaceTempView("vals")
    register_walk(spark, "gaps", Gaps, "k int, gap int")
    rows = spark.sql("SELECT * FROM gaps(TABLE(vals) PARTITION BY k ORDER BY v)").collect()
    assert sorted(map(tuple, rows)) == [(1, -2), (1, 2), (1, 5), (2, 0)]


def test_leaf_walk_takes_batches_and_long_groups(spark):
    assert hasattr(LeafArrays, "rows") and not hasattr(LeafArrays, "row")       # no Python call per leaf
    docs = spark.createDataFrame([(i, "a b c\n\n" * (40 if i == 3 else i % 4)) for i in range(30)] + [(None, "x y")], "doc_id bigint, text string")
    layout_leaves(docs, "doc_id", "text").repartition(7).createOrReplaceTempView("many_leaves")
    register_walk(spark, "walk_leaves", LeafArrays, LEAF_ARRAYS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")        # a group of 160 leaves spans batches
    try:
        walked = spark.sql("SELECT * FROM walk_leaves(TABLE(many_leaves) PARTITION BY doc_id ORDER BY leaf_pos)")
        got = sorted(map(str, walked.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = leaf_arrays(layout_leaves(docs, "doc_id", "text"), "doc_id").select(*walked.columns)
    assert got == sorted(map(str, want.collect())) and len(got) == 31
