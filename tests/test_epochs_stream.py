import datetime
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborform.operators import epochs as E
from arborform.operators import metrics
from arborform.session import fresh_subdir
from arborform.streaming import metric_stream, stream_metrics
from arborform.streaming.metrics_stream import add_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_places_are_a_bijection_and_go_back(spark, n):
    df = spark.range(n).crossJoin(spark.range(3).toDF("epoch"))
    df = df.withColumn("place", E.place_of(F.col("id"), n, 7, F.col("epoch")))
    rows = df.withColumn("back", E.rank_at(F.col("place"), n, 7, F.col("epoch"))).collect()
    orders = []
    for e in range(3):
        own = sorted((r.place, r.id) for r in rows if r.epoch == e)
        assert [p for p, _ in own] == list(range(n))
        orders.append([i for _, i in own])
    assert all(r.back == r.id for r in rows)
    if n >= 64:
        assert orders[0] != orders[1] != orders[2] and orders[0] != list(range(n))


def test_places_look_random(spark):
    """Neighbouring ranks land far apart, and every rank everywhere over the epochs."""
    n = 500
    rows = spark.range(n).crossJoin(spark.range(40).toDF("epoch")).withColumn("place", E.place_of(F.col("id"), n, "s", F.col("epoch"))).collect()
    at = {(r.epoch, r.id): r.place for r in rows}
    gaps = [abs(at[e, i + 1] - at[e, i]) for e in range(40) for i in range(n - 1)]
    assert abs(sum(gaps) / len(gaps) - n / 3) < n / 30             # two uniform places are n / 3 apart on average
    means = [sum(at[e, i] for e in range(40)) / 40 for i in range(n)]
    assert max(abs(m - n / 2) for m in means) < n / 2 * 0.8


def test_batches_and_a_batch_read_by_its_places(spark):
    df = spark.range(100).select((F.col("id") * 3).alias("k"))
    rows = E.epoch_batches(df.repartition(3), "k", 5, 2, 32).collect()
    for e in range(2):
        sizes = pd.Series([r.batch for r in rows if r.epoch == e]).value_counts()
        assert sizes.to_dict() == {0: 32, 1: 32, 2: 32, 3: 4}
    want = {(r.place, r.k // 3) for r in rows if r.epoch == 1 and r.batch == 3}
    assert {(r.place, r["rank"]) for r in E.batch_ranks(spark, 100, 5, 1, 3, 32).collect()} == want
    assert E.epoch_batches(df.limit(0), "k", 5, 2, 32).count() == 0
    assert [r[0] for r in spark.sql("select cast(null as bigint) as r").select(E.place_of(F.col("r"), 10, 1, F.lit(0))).collect()] == [None]


def _tokens(seed, batches=range(6)):
    rnd, rows = random.Random(seed), []
    for b in batches:
        for s in range(3 * b, 3 * b + 3):
            for _ in range(rnd.randint(1, 6)):
                rows.append((b, s, datetime.datetime(2024, 1, 1), [rnd.random() for _ in range(3)], rnd.choice([0, 1, 2, -100])))
    return rows


SCHEMA = "batch bigint, seq bigint, ts timestamp, logits array<double>, label int"


def _row(df):
    return [round(v, 9) for v in df.first()]


def test_streamed_metrics_equal_the_batch_ones_after_a_restart(spark, tmp_path):
    rows = _tokens(3)
    random.Random(1).shuffle(rows)                     # a batch's rows come in several files
    src, out, ckpt = str(tmp_path / "in"), fresh_subdir(spark, "out"), fresh_subdir(spark, "ckpt")
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def go():
        q = metric_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), out, ckpt)
        q.processAllAvailable()
        q.stop()
    put(rows[:20])
    put(rows[20:30])
    go()
    half = spark.createDataFrame(rows[:30], SCHEMA)
    want = lambda df, how="weighted": _row(metrics.evaluate_counts(
        df.groupBy("batch").agg(F.countDistinct("seq").alias("seqs")),
        df.filter("label <> -100").withColumn("pred", metrics.argmax(F.col("logits"))).withColumn("loss", metrics.row_loss(F.col("logits"), F.col("label")))
        .groupBy("batch", "label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss")), how))
    assert _row(stream_metrics(spark, out)) == want(half)
    put(rows[30:])
    go()                                               # the state comes back from the checkpoint
    every = spark.createDataFrame(rows, SCHEMA)
    assert _row(stream_metrics(spark, out)) == want(every)
    assert _row(stream_metrics(spark, out, "macro")) == want(every, "macro")
    # sequences in order, three to a batch: the same row as the batch job's own
    assert _row(stream_metrics(spark, out)) == _row(metrics.evaluate(every, "seq", 3))


def test_late_rows_and_closed_batches(spark, tmp_path):
    """A batch closes when the watermark has passed it; rows older than the watermark are not counted."""
    src, out, ckpt = str(tmp_path / "in"), fresh_subdir(spark, "out"), fresh_subdir(spark, "ckpt")
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    row = lambda b, s, m: (b, s, at(m), [1.0, 0.0], 0)
    for i, part in enumerate([[row(0, 0, 0)], [row(1, 1, 60)], [row(1, 2, 61)], [row(0, 9, 1), row(1, 3, 62)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = metric_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), out, ckpt, "5 minutes", 60_000)
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(out).collect()
    assert {r.closed for r in rows if r.batch == 0} == {False, True}
    assert max(r.n for r in rows if r.batch == 0) == 1          # the row of minute 1 came after the watermark
    assert max(r.n for r in rows if r.batch == 1) == 3 and not any(r.closed for r in rows if r.batch == 1)


def test_state_adds_up():
    a = pd.DataFrame({"seq": [1, 1, 2], "label": [0, None, 1], "pred": [1, None, 1], "loss": [0.5, None, 0.25]})
    kept = add_rows(None, a)
    assert kept == (0, [1, 2], [0, 1], [1, 1], [1, 1], [0.5, 0.25])
    assert add_rows(kept, a)[4:] == ([2, 2], [1.0, 0.5])
    assert add_rows(None, a[a["label"].isna()]) == (0, [1], [], [], [], [])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables missing")
@pytest.mark.parametrize("name", ["epoch_batches", "epoch_batch_rows", "metric_row_stream"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from arborform.plans.catalog import QUERIES
    from arborform.plans.oracle import sql_queries
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.sql(sql_queries()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    cols = sorted(df.columns)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[at[c]]) for c in cols) for r in rel.fetchall())


def test_stream_files_grow_with_the_sequences(spark, monkeypatch):
    from arborform.plans import catalog as C, params as P
    made = []
    plain = C.fresh_subdir
    monkeypatch.setattr(C, "fresh_subdir", lambda s, name: made.append(plain(s, name)) or made[-1])
    monkeypatch.setattr(C, "FILE_SEQS", 50)
    sf = "/root/testdata/sf0.001"
    got = C.q_metric_row_stream(spark, sf).first()
    src = next(x for x in made if "stream-in" in x)
    files = spark.read.parquet(src).inputFiles()
    assert len(files) > P.STREAM_FILES and len(files) <= 4 * P.STREAM_FILES     # 183 sequences, 8 files for each 50
    want = C.q_metric_row(spark, sf).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_stream_looks_its_logits_up(spark, monkeypatch):
    """The written positions have no vectors; each micro-batch gets those of its own rows."""
    from arborform.plans import catalog as C
    made, seen = [], []
    plain, stream = C.fresh_subdir, C.metric_stream
    monkeypatch.setattr(C, "fresh_subdir", lambda s, name: made.append(plain(s, name)) or made[-1])
    monkeypatch.setattr(C, "metric_stream", lambda rows, *a: seen.append((rows.isStreaming, rows.dtypes)) or stream(rows, *a))
    got = C.q_metric_row_stream(spark, SF).first()
    assert seen == [(True, [("batch", "bigint"), ("seq", "bigint"), ("ts", "timestamp"), ("logits", "array<double>"), ("label", "int")])]
    src = spark.read.parquet(next(x for x in made if "stream-in" in x))
    assert not any(kind.startswith("array") for _, kind in src.dtypes)
    want = C.masked_predictions(spark, SF).filter("label <> -100 or pos = 0")
    assert src.groupBy("vid", "label").count().exceptAll(want.groupBy("vid", "label").count()).isEmpty() and src.count() == want.count()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, C.q_metric_row(spark, SF).first()))


def test_state_of_many_pairs():
    rng = random.Random(4)
    rows = [(rng.randrange(9), rng.choice([None, 0, 1, 2, 3]), rng.randrange(4), rng.randrange(64) / 64) for _ in range(900)]
    kept = None
    for i in range(0, 900, 300):
        kept = add_rows(kept, pd.DataFrame([(s, a, None if a is None else p, None if a is None else x) for s, a, p, x in rows[i:i + 300]], columns=["seq", "label", "pred", "loss"]))
    pairs = sorted({(a, p) for _, a, p, _ in rows if a is not None})
    of = lambda pair: [x for _, a, p, x in rows if (a, p) == pair]
    assert kept == (0, list(range(9)), [a for a, _ in pairs], [p for _, p in pairs], [len(of(x)) for x in pairs], [sum(of(x)) for x in pairs])
    assert {type(v) for part in kept[1:5] for v in part} == {int} and {type(v) for v in kept[5]} == {float}
