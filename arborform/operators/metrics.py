"""Predictions -> arg-max, accuracy, per-class report, averages,
cross-entropy, batches and the one-row metric summary.

Predictions are never collected: everything is an aggregation, and the
per-class work runs on a (label x prediction) count table of k^2 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..session import written
from .splits import global_rank

IGNORE = -100


def argmax(col: Column) -> Column:
    """index of the largest value, first one on ties (NaN counts as largest)."""
    return bind(col, lambda a: F.array_position(a, F.array_max(a)) - 1).cast("int")


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """share of rows with pred == label."""
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """per class (seen as a label or a prediction): support, predicted,
    true positives, precision, recall, f1; 0/0 is 0."""
    return _report(df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")))


def _report(counts: DataFrame) -> DataFrame:
    """counts(l, p, n) -> the per-class rows."""
    by_label = counts.groupBy(F.col("l").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    by_pred = counts.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    r = by_label.join(by_pred, "cls", "full_outer").select(
        F.col("cls").cast("int").alias("cls"),
        F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
        F.coalesce("predicted", F.lit(0)).cast("bigint").alias("predicted"),
        F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"))
    tp, sup, prd = F.col("tp").cast("double"), F.col("support"), F.col("predicted")
    return r.select("cls", "support", "predicted", "tp",
                    F.when(prd > 0, tp / prd).otherwise(F.lit(0.0)).alias("precision"),
                    F.when(sup > 0, tp / sup).otherwise(F.lit(0.0)).alias("recall"),
                    F.when(sup + prd > 0, 2 * tp / (sup + prd)).otherwise(F.lit(0.0)).alias("f1"))


def macro(report: DataFrame) -> DataFrame:
    """unweighted mean over classes."""
    return report.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                      F.avg("f1").alias("f1"))


def weighted(report: DataFrame) -> DataFrame:
    """mean weighted by label support."""
    s = F.sum("support").cast("double")
    return report.agg(*[(F.sum(F.col(c) * F.col("support")) / s).alias(c)
                        for c in ("precision", "recall", "f1")])


def row_loss(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: log-sum-exp(logits) - logits[label]. A label
    that is no index of the logits fails the job."""
    def ce(a):
        def with_max(mx):
            lse = mx + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - mx)))
            return F.when((label < 0) | (label >= F.size(a)), F.raise_error(F.concat(
                F.lit("label outside the logits: "), label.cast("string")))).otherwise(lse - F.get(a, label))
        return bind(F.array_max(a), with_max)
    return bind(logits.cast("array<double>"), ce)


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """mean cross-entropy over rows whose label is not -100."""
    return (df.filter(F.col(label) != F.lit(IGNORE))
              .agg(F.avg(row_loss(F.col(logits), F.col(label))).alias("loss")))


def batch_ids(df: DataFrame, order, n: int) -> DataFrame:
    """consecutive batches of n rows in the given order (last one short).
    Only the order columns are laid out and written."""
    return global_rank(df, order).withColumn(
        "batch", F.floor(F.col("rank") / F.lit(n)).cast("bigint"))


def _counted(tokens: DataFrame, seq: str, n: int, logits: str, label: str,
             seqs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(batches with their number of sequences, sums per batch, label and
    prediction): what every metric below needs, from one scan of the tokens."""
    keys = tokens.select(seq).distinct() if seqs is None else seqs.select(seq)
    order = batch_ids(keys, seq, n).select(seq, "batch")
    sizes = order.groupBy("batch").agg(F.count(F.lit(1)).alias("seqs"))
    scored = tokens.filter(F.col(label) != F.lit(IGNORE)).select(
        seq, F.col(label).alias("label"), argmax(F.col(logits)).alias("pred"),
        row_loss(F.col(logits), F.col(label)).alias("loss"))
    # first per sequence: partial sums shrink the tokens before the join
    per_seq = scored.groupBy(seq, "label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"))
    sums = (per_seq.join(order, seq).groupBy("batch", "label", "pred")
            .agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")))
    return sizes, sums


def _weighted_loss(sizes: DataFrame, sums: DataFrame) -> DataFrame:
    per = sums.groupBy("batch").agg((F.sum("loss") / F.sum("n")).alias("m")).join(sizes, "batch")
    return per.agg((F.sum(F.col("m") * F.col("seqs")) / F.sum("seqs")).alias("loss"))


def batch_loss(tokens: DataFrame, seq: str, n: int, logits: str = "logits",
               label: str = "label", seqs: DataFrame | None = None) -> DataFrame:
    """F8: batches of n sequences; the mean loss over a batch's scored tokens,
    weighted by its number of sequences.

    tokens: one row per sequence position (seq, logits, label); ``seqs``: the
    sequences' keys, if known apart from the tokens. A batch without a scored
    token has no mean: it is left out, with its weight.
    """
    return _weighted_loss(*_counted(tokens, seq, n, logits, label, seqs))


def evaluate(tokens: DataFrame, seq: str, n: int, average: str = "weighted",
             logits: str = "logits", label: str = "label",
             seqs: DataFrame | None = None) -> DataFrame:
    """loss (F8's), accuracy, precision, recall, f1 in one row.

    One scan of the tokens: the counts per (batch, label, prediction) are written
    once, and loss, accuracy and averages come from them.
    """
    if average not in ("weighted", "macro"):
        raise ValueError(f"no such average: {average!r}")
    sizes, sums = _counted(tokens, seq, n, logits, label, seqs)
    return evaluate_counts(sizes, written(sums, "metric-counts"), average)


def evaluate_counts(sizes: DataFrame, sums: DataFrame, average: str = "weighted") -> DataFrame:
    """The metric row from counts: sizes(batch, seqs), sums(batch, label, pred, n, loss)."""
    pairs = sums.groupBy(F.col("label").alias("l"), F.col("pred").alias("p")).agg(F.sum("n").alias("n"))
    rep = _report(pairs)
    avg = macro(rep) if average == "macro" else weighted(rep)
    acc = pairs.agg((F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    # three one-row aggregates side by side (equi-join on a constant key)
    one = F.lit(0).alias("_one")
    return (_weighted_loss(sizes, sums).select("*", one)
            .join(acc.select("*", one), "_one")
            .join(avg.select("*", one), "_one")
            .select("loss", "accuracy", "precision", "recall", "f1"))
