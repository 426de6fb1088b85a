import math

import pytest
from pyspark.sql import functions as F

from arborform.functions.draw import draw
from arborform.operators import masking, metrics


def _preds(spark, labels, logits):
    return spark.createDataFrame([(i, [float(x) for x in lg], lb) for i, (lb, lg) in
                                  enumerate(zip(labels, logits))],
                                 "vec_id long, logits array<double>, label int")


def test_metrics_of_three_classes_all_right(spark):
    df = _preds(spark, [2, 0, 1, 1, 2], [[0, 1, 5], [4, 0, 0], [-1, 0, -2], [0, 9, 8], [1, 2, 3]])
    r = metrics.evaluate(df, "vec_id", 3, "macro").first()
    assert [r.accuracy, r.precision, r.recall, r.f1] == [1.0] * 4


def test_metrics_by_hand(spark):
    """Labels 0,0,0,1,1,2; predicted 0,0,1,1,2,2. Class 0: precision 2/2, recall 2/3,
    f1 4/5; class 1: 1/2, 1/2, 1/2; class 2: 1/2, 1/1, 2/3."""
    one = lambda k: [float(i == k) for i in range(3)]
    df = _preds(spark, [0, 0, 0, 1, 1, 2], [one(k) for k in (0, 0, 1, 1, 2, 2)])
    r = metrics.evaluate(df, "vec_id", 4, "macro").first()
    assert r.accuracy == pytest.approx(4 / 6)
    assert r.precision == pytest.approx((1 + 1 / 2 + 1 / 2) / 3)
    assert r.recall == pytest.approx((2 / 3 + 1 / 2 + 1) / 3)
    assert r.f1 == pytest.approx((4 / 5 + 1 / 2 + 2 / 3) / 3)


def test_class_only_predicted_counts_in_macro(spark):
    df = _preds(spark, [0, 0], [[2, 0], [0, 2]]).withColumn("pred", metrics.argmax(F.col("logits")))
    rep = {r.cls: r for r in metrics.class_report(df).collect()}
    assert set(rep) == {0, 1} and rep[1].support == 0 and rep[1].f1 == 0.0
    m = metrics.macro(metrics.class_report(df)).first()
    assert m.recall == pytest.approx(0.25)  # (0.5 + 0) / 2


def test_argmax_first_on_ties_and_cross_entropy_ignores(spark):
    df = _preds(spark, [1, -100], [[1, 3, 3], [0, 0, 9]])
    assert [r[0] for r in df.select(metrics.argmax(F.col("logits"))).collect()] == [1, 2]
    lse = math.log(math.exp(1) + 2 * math.exp(3))
    assert metrics.cross_entropy(df).first().loss == pytest.approx(lse - 3)


def test_batch_ids_and_weighted_loss(spark):
    df = _preds(spark, [0, 1, 0, 1, -100], [[1, 0]] * 5)
    b = {r.vec_id: r.batch for r in metrics.batch_ids(df, "vec_id", 2).collect()}
    assert b == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def _tokens(spark):
    """Three sequences; the batch of two is uneven in scored tokens, the last
    sequence has none."""
    rows = [(0, 0, [1.0, 0.0], 0), (0, 1, [3.0, 0.0], 1), (0, 2, [0.0, 2.0], 1), (0, 3, [0.0, 0.0], -100),
            (1, 0, [0.0, 1.0], 0), (1, 1, [5.0, 0.0], -100), (2, 0, [0.0, 4.0], 0), (3, 0, [9.0, 0.0], -100)]
    return spark.createDataFrame(rows, "s long, pos int, logits array<double>, label int")


def _ce(logits, label):
    return math.log(sum(math.exp(x) for x in logits)) - logits[label]


def test_batch_loss_has_sequence_grain(spark):
    one = [_ce([1, 0], 0), _ce([3, 0], 1), _ce([0, 2], 1), _ce([0, 1], 0)]
    two = [_ce([0, 4], 0)]
    want = (sum(one) / 4 * 2 + sum(two) / 1 * 2) / 4           # weights: sequences of the batch
    assert metrics.batch_loss(_tokens(spark), "s", 2).first().loss == pytest.approx(want)
    r = metrics.evaluate(_tokens(spark), "s", 2).first()
    assert r.loss == pytest.approx(want) != pytest.approx(sum(one + two) / 5)
    assert r.accuracy == pytest.approx(2 / 5)
    # a batch without scored tokens is left out with its weight
    alone = metrics.batch_loss(_tokens(spark), "s", 1).first().loss
    assert alone == pytest.approx((sum(one[:3]) / 3 + one[3] + two[0]) / 3)


def test_label_outside_the_logits_fails(spark):
    df = _preds(spark, [2], [[1, 0]])
    with pytest.raises(Exception, match="label outside the logits"):
        metrics.cross_entropy(df).collect()
    with pytest.raises(ValueError):
        metrics.evaluate(df, "vec_id", 2, "micro")


def test_draw_is_repeatable_and_seed_dependent(spark):
    df = spark.range(50).repartition(7)
    a = sorted(df.select("id", draw(1, F.col("id")).alias("u")).collect())
    b = sorted(spark.range(50).select("id", draw(1, F.col("id")).alias("u")).collect())
    c = sorted(spark.range(50).select("id", draw(2, F.col("id")).alias("u")).collect())
    assert a == b and a != c
    assert all(0.0 <= r.u < 1.0 for r in a)


def test_mask_eval_never_touches_specials(spark):
    ids = [0] + list(range(5, 400)) + [2] + [0] * 10
    df = spark.createDataFrame([(1, ids)], "doc_id long, input_ids array<int>")
    r = masking.mask_tokens(df, "doc_id", 0.15, 123).first()
    chosen = [i for i, lab in enumerate(r.labels) if lab != -100]
    assert 20 < len(chosen) < 110
    for i, (orig, new, lab) in enumerate(zip(ids, r.input_ids, r.labels)):
        if i in chosen:
            assert new == 4 and lab == orig and orig >= 5
        else:
            assert new == orig and lab == -100
    again = masking.mask_tokens(df, "doc_id", 0.15, 123).first()
    assert again.input_ids == r.input_ids


def test_mask_train_rates(spark):
    ids = [0] + [7] * 4000 + [2]
    df = spark.createDataFrame([(1, ids)], "doc_id long, input_ids array<int>")
    r = masking.mask_tokens_train(df, "doc_id", 0.5, 9, vocab_size=100).first()
    chosen = [i for i, lab in enumerate(r.labels) if lab != -100]
    to_mask = sum(1 for i in chosen if r.input_ids[i] == 4)
    assert 0.7 < to_mask / len(chosen) < 0.9
    assert masking.scored(df.withColumn("labels", F.lit(r.labels)), "doc_id").count() == len(chosen)


@pytest.mark.parametrize("p", [0, 0.15, 0.5, 1, 2])
def test_masked_positions_are_those_of_the_draw(spark, p):
    ids = [0, 3, None] + list(range(5, 300)) + [2]
    df = spark.createDataFrame([(7, ids)], "doc_id long, input_ids array<int>")
    masked = masking.mask_tokens(df, "doc_id", p, 123)
    # no number is made of a digest to compare it with p
    assert "conv(" not in masked._jdf.queryExecution().optimizedPlan().toString()
    u = {r.i: r.u for r in spark.range(len(ids)).select(F.col("id").alias("i"), draw(123, F.lit(7), F.col("id")).alias("u")).collect()}
    r, t = masked.first(), masking.mask_tokens_train(df, "doc_id", p, 123, vocab_size=300).first()
    want = [x if x is not None and x > 4 and u[i] < p else -100 for i, x in enumerate(ids)]
    assert r.labels == want == t.labels
    assert r.input_ids == [x if y == -100 else 4 for x, y in zip(ids, want)]
