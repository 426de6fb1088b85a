import os
import tempfile

from pyspark.sql import functions as F

from arborform.session import fresh_subdir
from arborform.sources.tables import read_split, write_features
from arborform.streaming import feature_stream


def test_split_table_round_trip(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "doc_id long, split string")
    path = fresh_subdir(spark, "t")
    write_features(df, path)
    assert sorted(r.doc_id for r in read_split(spark, path, "train").collect()) == [1, 3]
    assert read_split(spark, path).count() == 3


def test_feature_stream_matches_batch(spark, stub_vocab):
    src = tempfile.mkdtemp(prefix="arborform-stream-src-")
    docs = spark.createDataFrame([(1, "x = 1", "en", "train"), (2, "a + b\nx", "en", "test")],
                                 "doc_id long, text string, lang string, split string")
    docs.write.mode("overwrite").parquet(os.path.join(src, "part"))
    out = fresh_subdir(spark, "stream-out")
    q = feature_stream(spark, os.path.join(src, "part"), stub_vocab, out,
                       fresh_subdir(spark, "stream-ckpt"), length=16)
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2} and got[2].split == "test"
    assert got[1].input_ids[:5] == [0, 5, 6, 7, 2] and len(got[1].input_ids) == 16
