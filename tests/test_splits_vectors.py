import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborform.functions.draw import draw_int
from arborform.operators import splits, vectors


def test_half_split_is_exact_first_half(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "doc_id").repartition(5)
    got = splits.half_split(df, "doc_id", 11).collect()
    d = {r.doc_id: r.part for r in got}
    assert sum(1 for v in d.values() if v == "valid") == 500
    order = sorted(spark.range(0, 1001).select(
        F.col("id"), draw_int(11, "half", F.col("id")).alias("d")).collect(), key=lambda r: (r.d, r.id))
    assert {r.id for r in order[:500]} == {k for k, v in d.items() if v == "valid"}
    first = [r.doc_id for r in splits.first_n(df, "doc_id", 11, 20).collect()]
    assert first == [r.id for r in order[:20]]


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("k")).repartition(6)
    ranks = {r.k: r.rank for r in splits.global_rank(df, "k", partitions=5).collect()}
    assert [ranks[k] for k in sorted(ranks)] == list(range(3000))


def test_assign_split_fractions(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    n = {r.split: r["count"] for r in splits.assign_split(df, "doc_id", 3).groupBy("split").count().collect()}
    assert 3800 < n["train"] < 4200 and 350 < n["validation"] < 650


def test_fusion_and_layer_norm(spark):
    v = [float(i) for i in range(4)]
    df = spark.createDataFrame([(v, v, v, v, v, 1, 0)],
                               "w array<double>, t array<double>, p array<double>, d array<double>, "
                               "s array<double>, don int, son int")
    cols = [F.col(c) for c in ["w", "t", "p", "d", "s", "don", "son"]]
    r = df.select(vectors.fuse_sum(*cols).alias("a"), vectors.fuse_concat(*cols).alias("c"),
                  vectors.fuse_weighted(*cols, weights={"word": 2.0}).alias("w"),
                  vectors.layer_norm(vectors.fuse_sum(*cols), 1e-5).alias("n")).first()
    assert r.a == [4 * x for x in v]                       # sibling switched off
    assert len(r.c) == 20 and r.c[16:] == [0.0] * 4
    assert r.w == [5 * x for x in v]
    assert sum(r.n) == pytest.approx(0.0, abs=1e-9)
    assert sum(x * x for x in r.n) / 4 == pytest.approx(1.0, abs=1e-4)


def test_group_rank_hot_group_matches_window(spark):
    from pyspark.sql import Window
    # group 0 holds a third of the rows and repeated order values
    rows = [(0 if i % 3 == 0 else i % 50, (i * 37) % 400, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g long, o long, t long")
    got = {r.t: r.rank for r in splits.group_rank(df, "g", "o", "t").collect()}
    w = Window.partitionBy("g").orderBy("o", "t")
    want = {r.t: r.rk for r in df.select("t", (F.row_number().over(w) - 1).alias("rk")).collect()}
    assert got == want


def test_lookup_of_an_id_outside_the_table_fails(spark):
    rows = spark.createDataFrame([(1, 0), (2, 3), (3, None)], "k int, vid int")
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="outside its vector table"):
        vectors.lookup(rows, table, "vid", "v", bound=2, dim=1).collect()
    got = {r.k: r.v for r in vectors.lookup(rows, table, "vid", "v", bound=2, dim=1, strict=False).collect()}
    assert got == {1: [1.0], 2: None, 3: None}


def test_unknown_fusion_is_an_error():
    with pytest.raises(ValueError, match="no such fusion"):
        vectors.fuse("mean", *[None] * 7)


def test_assemble_keeps_every_row(spark):
    from arborform.plans.catalog import q_assemble
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        out = q_assemble(spark, d)
        assert out.count() == out.select("doc_id").distinct().count() == spark.read.parquet(f"{d}/documents.parquet").count()


def _quality(rows):
    ones, right = sum(r.labels for r in rows), sum(r.labels == r.prediction for r in rows)
    both = sum(r.labels and r.prediction for r in rows)
    return right, max(ones, len(rows) - ones), 2 * both / max(1, ones + sum(r.prediction for r in rows))


def test_classifier_beats_the_majority_on_held_out_pairs(spark):
    """Sides are alike if their classes are: the label is no linear function of the sides."""
    import numpy as np

    from arborform.operators.pair_model import fit_pairs, score_pairs
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(4, 6))
    kinds = rnd.integers(0, 4, size=(1500, 2))
    rows = [(i, [*map(float, centres[a] + 0.3 * rnd.normal(size=6)), *map(float, centres[b] + 0.3 * rnd.normal(size=6))], int(a == b)) for i, (a, b) in enumerate(kinds)]
    data = splits.assign_split(spark.createDataFrame(rows, "pair_id long, pair_vec array<double>, labels int"), "pair_id", 5)
    part = lambda name: data.filter(F.col("split") == name)
    model = fit_pairs(part("train"), part("validation"), seed=3, tasks=3)
    assert len(model.valid_loss) == 12 and min(model.valid_loss) < model.valid_loss[0]
    test = score_pairs(model, part("test")).collect()
    right, majority, f1 = _quality(test)
    assert right > 1.1 * majority and f1 > 0.8
    again = fit_pairs(part("train"), part("validation"), seed=3, tasks=3)
    assert all(np.allclose(a, b) for a, b in zip(model.weights, again.weights))


def test_tasks_meet_at_the_mean(spark):
    """Three tasks whose rows are all alike take the steps that one would."""
    import numpy as np

    from arborform.operators import pair_model as M
    df = spark.createDataFrame([(i, [1.0, -2.0, 0.5, 3.0], 1) for i in range(90)], "k long, x array<double>, y int")
    start = lambda: M.PairModel(np.zeros(4), np.ones(4), [np.full((4, 3), 0.1), np.zeros(3), np.full((3, 2), 0.2) * [[1, -1]], np.zeros(2)], (1.0, 2.0),
                                [(np.zeros(s), np.zeros(s)) for s in ((4, 3), 3, (3, 2), 2)])
    got, want = M._epoch(df, start(), 0, 3, 0.05, 0.0, 7), start()
    for _ in range(got.steps):
        _, weight, g = want.loss_and_gradients(np.array([[1.0, -2.0, 0.5, 3.0]]), np.array([1]))
        want.step([x / weight for x in g], 0.05, 0.0)
    assert 1 <= got.steps <= 3 and max(np.abs(a - b).max() for a, b in zip(got.weights, want.weights)) < 0.1


def test_mini_batches_hold_every_row_once():
    import pyarrow as pa

    from arborform.operators.pair_model import _mini_batches
    for sizes in ([], [0], [5], [32], [64], [10, 70, 0, 3], [31, 1, 33]):
        at, batches = 0, []
        for n in sizes:
            batches.append(pa.RecordBatch.from_arrays([pa.array([[float(at + i)] for i in range(n)], pa.list_(pa.float64())), pa.array([0] * n, pa.int32())], names=["x", "y"]))
            at += n
        got = list(_mini_batches(iter(batches), 32))
        assert [v for x, _, _ in got for v in x[:, 0].tolist()] == list(range(at))
        assert [more for *_, more in got] == [True] * (len(got) - 1) + [False] * bool(got)


def test_pair_model_odd_rows(spark):
    import numpy as np

    from arborform.operators import pair_model as M
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 5.0], 1), (2, None, 0), (None, [1.0, 1.0, 1.0, 1.0], None)], "pair_id long, pair_vec array<double>, labels int")
    assert [list(r[0]) if r[0] else r[0] for r in df.select(M.interactions(F.col("pair_vec"))).collect()] == [[2.0, 3.0, 3.0, 10.0], None, [0.0, 0.0, 1.0, 1.0]]
    model = M.PairModel(np.zeros(4), np.ones(4), [np.ones((4, 2)), np.zeros(2), np.array([[1.0, -1.0]] * 2), np.zeros(2)])
    got = {r.pair_id: r.prediction for r in M.score_pairs(model, df).collect()}
    assert got == {1: 0, 2: None, None: 0}
    with pytest.raises(ValueError, match="both classes"):
        M.fit_pairs(df, df)


def test_bucketed_lookup_equals_the_broadcast_one(spark, tmp_path):
    import uuid
    table = spark.range(60).select(F.col("id").cast("int").alias("vec_id"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("embedding"))
    name = vectors.bucket_table(table, "v" + uuid.uuid4().hex, 4, str(tmp_path / "b"))
    # id 7 is hot: half of all rows
    rows = spark.range(900).select("id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 45 != 1, (F.col("id") % 60)).cast("int").alias("vid"))
    got = vectors.lookup_bucketed(rows, name, "vid", "v", 4)
    want = vectors.lookup(rows, table, "vid", "v", bound=60, dim=2)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # the table's side of the join is not exchanged
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    side = plan[plan.index("SortMergeJoin"):]
    assert side.count("hashpartitioning(_id") == 1 and "hashpartitioning(_vid" not in side and "SelectedBucketsCount: 4 out of 4" in side
    with pytest.raises(Exception, match="outside its vector table"):
        vectors.lookup_bucketed(spark.createDataFrame([(99,)], "vid int"), name, "vid", "v", 4).collect()
    assert vectors.lookup_bucketed(spark.createDataFrame([(99,)], "vid int"), name, "vid", "v", 4, strict=False).first().v is None


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_pair_query_beats_the_majority(spark, sf):
    import os

    from arborform.plans.catalog import pair_scores
    if not os.path.exists(f"/root/testdata/{sf}"):
        pytest.skip("test tables missing")
    right, majority, f1 = _quality(pair_scores(spark, f"/root/testdata/{sf}").collect())
    assert right > majority and f1 > 0


def test_vocabulary_equals_a_plain_sort(spark):
    from arborform.operators.vocab import build_vocab
    toks = spark.range(3000).select(F.concat(F.lit("t"), (F.col("id") * F.col("id") % 211)).alias("token"))
    n = {r.token: r["count"] for r in toks.groupBy("token").count().collect()}
    want = sorted(n, key=lambda t: (-n[t], t))[:40]
    got = {r.id: r.token for r in build_vocab(toks, 40).collect()}
    assert [got[5 + i] for i in range(40)] == want and len(got) == 45


def _position_rows(spark, n=700):
    tables = {x: spark.range(40 + k).select(F.col("id").cast("int").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.sin(F.col("id") * 7 + j + k)).alias("embedding"))
              for k, x in enumerate(vectors.SOURCES)}
    # the last half is padding: equal ids and factors
    at = F.when(F.col("k") < n // 2, F.col("k")).otherwise(0)
    rows = spark.range(n).select(F.col("id").alias("k")).select(
        "k", *[((at * (3 + j)) % 40).cast("int").alias(f"{x}_id") for j, x in enumerate(vectors.SOURCES)],
        (at % 2).cast("int").alias("depth_on"), (at % 3 % 2).cast("int").alias("sib_on"))
    return rows, tables, {x: 45 for x in vectors.SOURCES}


@pytest.mark.parametrize("mode,eps", [("sum", 1e-5), ("sum", None), ("weighted", None), ("concat", None)])
def test_fused_in_one_pass_equals_plain_arithmetic(spark, mode, eps):
    import functools
    import hashlib
    import math
    from arborform.functions.arrays import numbers_md5
    rows, tables, sizes = _position_rows(spark)
    weights = {"type": 0.5, "sibling": 1.5}
    got = {r.k: r.v for r in vectors.fused(rows, tables, sizes, 6, mode, "v", weights=weights, eps=eps).collect()}
    digest = {r.k: r.v for r in vectors.fused(rows, tables, sizes, 6, mode, "v", weights=weights, eps=eps, of=numbers_md5(), kind="string").collect()}
    vec = {x: {r.id: list(r.embedding) for r in t.collect()} for x, t in tables.items()}
    w = [weights.get(x, 1.0) if mode == "weighted" else 1.0 for x in vectors.SOURCES]
    for r in rows.collect():
        five = [vec[x][r[f"{x}_id"]] for x in vectors.SOURCES]
        five[3:] = [[y * r.depth_on for y in five[3]], [y * r.sib_on for y in five[4]]]
        if mode == "concat":
            want = [y for v in five for y in v]
        else:
            want = [((((a * w[0] + b * w[1]) + c * w[2]) + d * w[3]) + e * w[4]) for a, b, c, d, e in zip(*five)]
        if eps is not None:
            mean, var = functools.reduce(lambda a, y: a + y, want, 0.0) / 6, 0.0
            for y in want:
                var += (y - mean) * (y - mean)
            want = [(y - mean) / math.sqrt(var / 6 + eps) for y in want]
        assert list(got[r.k]) == want
        assert digest[r.k] == hashlib.md5(",".join(str(round(y * 1e6)) for y in want).encode()).hexdigest()


def test_fused_joins_a_table_with_repeats_and_gaps(spark):
    rows, tables, sizes = _position_rows(spark, 40)
    twice = dict(tables, type=tables["type"].union(tables["type"].filter("id = 0")))
    assert vectors.fused(rows, twice, sizes, 6, "sum", "v").filter("k >= 20").count() == 40     # as a join gives them
    none = dict(tables, type=tables["type"].withColumn("embedding", F.when(F.col("id") != 0, F.col("embedding"))))
    got = {r.k: r.v for r in vectors.fused(rows, none, sizes, 6, "sum", "v").collect()}
    assert got[39] == [None] * 6 and None not in got[1]
    for missing in (dict(tables, word=tables["word"].filter("id <> 0")), dict(twice, word=tables["word"].filter("id <> 0"))):
        with pytest.raises(Exception, match="outside its vector table"):
            vectors.fused(rows, missing, sizes, 6, "sum", "v").collect()


def _feature_rows(spark):
    """Rows of 9 positions of which the last two are padding; the first tables serve ``_position_rows`` too."""
    places = F.sequence(F.lit(0), F.lit(8))
    ids = lambda a, pad: F.transform(places, lambda j: F.when(j > 6, pad).otherwise((F.col("id") * a + j) % 40 + pad).cast("int"))
    rows = spark.range(60).select(
        F.col("id").alias("k"), ids(3, 0).alias("word_id"), ids(1, 0).alias("type_id"), ids(1, 0).alias("position_id"), ids(7, -1).alias("depths"),
        ids(5, -1).alias("sibling_indices"), F.transform(places, lambda j: ((F.col("id") + j) % 3 > 0).cast("int")).alias("tree_attention_mask"))
    z = F.arrays_zip("word_id", "type_id", "position_id", "depths", "sibling_indices", "tree_attention_mask")
    flat = rows.select("k", F.posexplode(z).alias("pos", "z")).select(
        "k", "pos", "z.word_id", "z.type_id", "z.position_id", F.greatest("z.depths", F.lit(0)).alias("depth_id"),
        F.greatest("z.sibling_indices", F.lit(0)).alias("sibling_id"), ((F.col("z.depths") >= 0).cast("int") * F.col("z.tree_attention_mask")).alias("depth_on"),
        ((F.col("z.sibling_indices") >= 0).cast("int") * F.col("z.tree_attention_mask")).alias("sib_on"))
    return rows, flat


@pytest.mark.parametrize("mode,of", [("sum", False), ("concat", False), ("concat", True)])
def test_fused_of_feature_rows_equals_that_of_their_positions(spark, monkeypatch, mode, of):
    from arborform.functions.arrays import numbers_md5
    rows, flat = _feature_rows(spark)
    _, tables, sizes = _position_rows(spark, 2)
    how = {"of": numbers_md5(), "kind": "string"} if of else {}
    # a digest of vectors as one joins them: no texts of their parts
    plain = {"of": lambda v, g=numbers_md5(): g(v), "kind": "string"} if of else {}
    got = lambda df: {(r.k, r.pos): r.v for r in df.collect()}
    want = got(vectors.fused(flat, tables, sizes, 6, mode, "v", **plain))
    assert len(want) == 540
    assert got(vectors.fused(rows, tables, sizes, 6, mode, "v", pos_col="pos", **how)) == want
    assert got(vectors.fused(flat, tables, sizes, 6, mode, "v", **how)) == want
    monkeypatch.setattr(vectors, "FUSED_POSITIONS", 20)
    monkeypatch.setattr(vectors, "FUSED_ROWS", 4)
    monkeypatch.setattr(vectors, "PIECE", 4)
    monkeypatch.setattr(vectors, "TEXT_BYTES", 1)
    assert got(vectors.fused(rows, tables, sizes, 6, mode, "v", pos_col="pos", **how)) == want
    twice = dict(tables, type=tables["type"].union(spark.createDataFrame([(99, [0.0] * 6)] * 2, "id int, embedding array<double>")))
    assert got(vectors.fused(rows, twice, sizes, 6, mode, "v", pos_col="pos", **how)) == want     # by joins
    uneven = rows.withColumn("depths", F.slice("depths", 1, 8))
    with pytest.raises(Exception, match="without an id or factor"):
        vectors.fused(uneven, tables, sizes, 6, mode, "v", pos_col="pos", **how).collect()


def test_texts_of_concatenated_vectors_are_made_per_table_row(spark):
    from arborform.functions.arrays import numbers_md5
    rows, flat = _feature_rows(spark)
    _, tables, sizes = _position_rows(spark, 2)
    seen = spark.sparkContext.accumulator(0)
    of = numbers_md5()

    class Counted:
        sep = of.sep

        def texts(self, m):
            seen.add(len(m))
            return of.texts(m)

        def __call__(self, v):
            seen.add(5 * len(v))
            return of(v)
    one = vectors.fused(rows.coalesce(1), tables, sizes, 6, "concat", "v", of=Counted(), kind="string", pos_col="pos")
    assert len({r.v for r in one.collect()}) > 300
    assert seen.value <= 3 * 41 + 2 * 2 * 41          # ids of five tables, two of them with two factors


def test_combinations_are_numbered_past_64_bits():
    import numpy as np
    cols = [np.arange(3000) * (k + 1) % 2999 for k in range(8)]
    first, inv = vectors._numbered(cols)
    assert len(first) == len({*zip(*(c.tolist() for c in cols))}) and all((c[first][inv] == c).all() for c in cols)


def test_lookup_of_what_the_vector_gives_is_computed_per_table_row(spark, tmp_path):
    import uuid
    table = spark.range(8).select(F.col("id").cast("int").alias("vec_id"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("embedding"))
    rows = spark.range(90).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 8).cast("int").alias("vid"))
    seen = spark.sparkContext.accumulator(0)

    def total(v):
        @F.arrow_udf("double")
        def run(x):
            seen.add(len(x))
            return pa.array([float(sum(y)) for y in x.to_pylist()])
        return run(v)
    want = {r.id: 3.0 * r.vid for r in rows.collect()}
    assert {r.id: r.v for r in vectors.lookup(rows, table, "vid", "v", bound=8, dim=2, of=total).collect()} == want
    assert seen.value == 8
    name = vectors.bucket_table(table, "v" + uuid.uuid4().hex, 4, str(tmp_path / "b"))
    assert {r.id: r.v for r in vectors.lookup_bucketed(rows, name, "vid", "v", 4, of=total).collect()} == want


def test_exchanges_of_an_epoch_stop_growing():
    from arborform.operators import pair_model as M
    assert M.sync_steps(390_000, 12) == M.SYNC_STEPS == M.sync_steps(10, 1)
    for rows in (1_000_000, 50_000_000):
        steps = -(-rows // (M.STEP_ROWS * 12))
        assert steps / M.sync_steps(rows, 12) <= M.SYNCS


def test_id_shares(spark):
    from arborform.operators.vectors import id_shares
    rows = [(1, [0, 5, 9, 13, 6, 2]), (2, [0, 4]), (3, []), (4, None), (5, [None, 7])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    out = {r.k: r.v for r in df.select("k", id_shares(F.col("ids"), 4, 4).alias("v")).collect()}
    assert out == {1: [0.0, 0.75, 0.25, 0.0], 2: None, 3: None, 4: None, 5: [0.0, 0.0, 0.0, 1.0]}
    none = df.filter("k = 3").select(id_shares(F.col("ids"), 4, 4).alias("v")).collect()
    assert none == [(None,)]
