"""Pair classifier on interactions of the two sides, trained in barrier stages.

A pair vector is the two sides end to end. Whether sides are alike shows in how
they differ and agree, place by place: the features are |u - v| and u * v,
standardised by their mean and deviation over the training rows. One hidden
layer and two class scores follow, as in a classifier head.

Training streams over rows of any number. An epoch is one barrier stage: its
tasks run together, each reads its share of the rows in an order drawn anew for
the epoch and takes mini-batch gradient steps (Adam). Every SYNC_STEPS steps, or a
SYNCS-th of a task's steps where that is more, and at the end, all tasks exchange
their weights and moments (``allGather``) and go on from the mean, weighted by rows;
an exchange takes a second whatever it holds, so there is none for each step and
their number stops growing with the rows (from STEP_ROWS x SYNC_STEPS x SYNCS rows a
task). A task holds a mini-batch and the weights, never its share
of the rows; weights are a few thousand numbers. Classes are weighted by the inverse of their frequency. After
every epoch the loss on validation rows is averaged by Spark, and the weights of
the lowest one are kept. If a task is lost, Spark repeats its epoch from the
weights before it.
"""

from __future__ import annotations

import base64
import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.batches import ship_package_by_value
from ..session import written

STEP_ROWS = 32          # rows of a mini-batch
SYNC_STEPS = 64         # steps of a task between two exchanges, at least
SYNCS = 16              # exchanges that an epoch's rows are spread over, about
MAX_TASKS = 64          # tasks that train together


def interactions(pair_vec: Column) -> Column:
    """|u - v| and u * v of a pair vector (u, v)."""
    def both(p):
        d = (F.size(p) / 2).cast("int")
        u, v = F.slice(p, F.lit(1), d), F.slice(p, d + 1, d)
        return F.concat(F.zip_with(u, v, lambda x, y: F.abs(x - y)), F.zip_with(u, v, lambda x, y: x * y))
    return bind(pair_vec, both)


@dataclass
class PairModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: list                       # hidden weights and bias, class weights and bias
    class_weight: tuple = (1.0, 1.0)
    moments: list = field(default_factory=list)
    steps: int = 0
    valid_loss: list = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray):
        """Sums over the rows, weighted by class."""
        w1, b1, w2, b2 = self.weights
        x = (x - self.mean) / self.scale
        hidden = np.tanh(x @ w1 + b1)
        s = hidden @ w2 + b2
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        weight = np.array(self.class_weight)[y]
        loss = -(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * weight).sum()
        d = p * weight[:, None]
        d[np.arange(len(y)), y] -= weight
        back = d @ w2.T * (1 - hidden ** 2)
        return loss, weight.sum(), [x.T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]

    def step(self, gradients: list, rate: float, decay: float):
        """One Adam step."""
        self.steps += 1
        for i, (w, g) in enumerate(zip(self.weights, gradients)):
            g = g + decay * w
            m, v = (0.9 * self.moments[i][0] + 0.1 * g), (0.999 * self.moments[i][1] + 0.001 * g * g)
            self.moments[i] = (m, v)
            self.weights[i] = w - rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.999 ** self.steps)) + 1e-8)


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0)
    n = batch.num_rows
    at = x.offsets.to_numpy()
    return x.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].reshape(n, -1).astype(float), batch.column(1).to_numpy().astype(int)


def _mini_batches(batches, rows: int):
    """(x, y, whether more follow) of ``rows`` rows each, the last one shorter."""
    held, n, ready = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_columns(batch))
        n += batch.num_rows
        while n >= rows:
            x, y = (np.concatenate(v) for v in zip(*held))
            if ready:
                yield *ready, True
            ready, held, n = (x[:rows], y[:rows]), [(x[rows:], y[rows:])], n - rows
    if n:
        if ready:
            yield *ready, True
        ready = tuple(np.concatenate(v) for v in zip(*held))
    if ready:
        yield *ready, False


def _epoch(rows: DataFrame, model: PairModel, epoch: int, tasks: int, rate: float, decay: float, seed: int,
           sync: int | None = None) -> PairModel:
    """The model after one pass over ``rows`` (x, y, k)."""
    ship_package_by_value()
    between = sync or SYNC_STEPS

    def run(batches):
        from pyspark import BarrierTaskContext
        context, parts = BarrierTaskContext.get(), _mini_batches(batches, STEP_ROWS)
        if not model.moments:
            model.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights]
        shapes = [w.shape for w in model.weights] * 3
        cut, more = np.cumsum([int(np.prod(s)) for s in shapes])[:-1], True
        while True:
            seen = 0
            for _ in range(between if more else 0):
                x, y, more = next(parts, (None, None, False))
                if x is not None:
                    _, weight, gradients = model.loss_and_gradients(x, y)
                    model.step([g / weight for g in gradients], rate, decay)
                    seen += len(y)
                if not more:
                    break
            state = [*model.weights, *[m for m, _ in model.moments], *[v for _, v in model.moments]]
            sent = np.concatenate([[seen, more, model.steps], *[s.ravel() for s in state]])
            all_ = np.array([np.frombuffer(base64.b64decode(s)) for s in context.allGather(base64.b64encode(sent.tobytes()).decode())])
            if all_[:, 0].sum():
                mean = [v.reshape(s) for v, s in zip(np.split(all_[:, 0] @ all_[:, 3:] / all_[:, 0].sum(), cut), shapes)]
                k = len(model.weights)
                model.weights, model.moments, model.steps = mean[:k], list(zip(mean[k:2 * k], mean[2 * k:])), int(all_[:, 2].max())
            if not all_[:, 1].any():            # no task has rows left
                break
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.moments, model.steps))], pa.binary())], names=["state"])
    order = F.xxhash64(F.lit(seed), F.lit(epoch), "k")
    dealt = rows.select("x", "y", order.alias("o")).repartition(tasks, "o").sortWithinPartitions("o").select("x", "y")
    weights, moments, steps = pickle.loads(dealt.mapInArrow(run, "state binary", barrier=True).collect()[0]["state"])      # one row, from the first task
    return replace(model, weights=weights, moments=moments, steps=steps)


def sync_steps(rows: int, tasks: int) -> int:
    """Steps between two exchanges in an epoch over ``rows``."""
    return max(SYNC_STEPS, -(-rows // (STEP_ROWS * tasks * SYNCS)))


def mean_loss(rows: DataFrame, model: PairModel) -> float:
    """Class-weighted mean loss over ``rows`` (x, y)."""
    ship_package_by_value()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                loss, weight, _ = model.loss_and_gradients(*_columns(batch))
                yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([float(weight)])], names=["loss", "weight"])
    total = rows.select("x", "y").mapInArrow(run, "loss double, weight double").agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight")).first()
    return total["loss"] / total["weight"] if total["weight"] else float("inf")


def fit_pairs(train: DataFrame, valid: DataFrame, key: str = "pair_id", features_col: str = "pair_vec", label: str = "labels",
              hidden: int = 32, epochs: int = 12, rate: float = 0.01, decay: float = 1e-4, seed: int = 0, tasks: int | None = None) -> PairModel:
    """E7 fit. ``valid``: rows on which the best epoch is chosen. ``tasks`` run
    at the same time and must find free slots (default: the cluster's, 64 at
    most). Rows without a label or vector are not used."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    spark = train.sparkSession

    def ready(df):
        rows = df.filter(F.col(label).isNotNull() & F.col(features_col).isNotNull())
        return rows.select(interactions(F.col(features_col)).alias("x"), F.col(label).cast("int").alias("y"), F.col(key).alias("k"))
    rows, check = written(ready(train), "pairs-train"), written(ready(valid), "pairs-valid")
    stats = rows.agg(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")) \
        .select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"), "n", "ones").first()
    if not stats["n"] or not 0 < stats["ones"] < stats["n"]:
        raise ValueError("training rows of both classes are needed")
    rnd, width = np.random.default_rng(seed), len(stats["mean"])
    start = [rnd.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), rnd.normal(0, hidden ** -0.5, (hidden, 2)), np.zeros(2)]
    std = np.array(stats["std"])
    share = stats["ones"] / stats["n"]
    model = PairModel(np.array(stats["mean"]), np.where(std > 0, std, 1.0), start, (0.5 / (1 - share), 0.5 / share))
    tasks = tasks or min(MAX_TASKS, spark.sparkContext.defaultParallelism)
    best, losses = model, []
    for epoch in range(epochs):
        model = _epoch(rows, model, epoch, tasks, rate, decay, seed, sync_steps(stats["n"], tasks))
        losses.append(mean_loss(check, model))
        if losses[-1] <= min(losses):
            best = model
    return replace(best, valid_loss=losses)


def score_pairs(model: PairModel, df: DataFrame, key: str = "pair_id", features_col: str = "pair_vec", label: str = "labels") -> DataFrame:
    """E7 score: (key, label, prediction, scores): the class of the higher of two
    scores; both null for a null pair vector."""
    ship_package_by_value()
    rows = df.select(interactions(F.col(features_col)).alias("x"), F.col(label).cast("int").alias(label), F.col(key).alias(key))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            there = batch.column(0).is_valid()
            some = batch.filter(there)
            scores, at = [None] * batch.num_rows, np.flatnonzero(there.to_numpy(zero_copy_only=False))
            if len(at):
                for i, s in zip(at.tolist(), model.scores(_columns(some.set_column(1, "y", pa.array(np.zeros(len(at), np.int32))))[0]).tolist()):
                    scores[i] = s
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([None if s is None else int(s[1] > s[0]) for s in scores], pa.int32()),
                                              pa.array(scores, pa.list_(pa.float64()))], names=[key, label, "prediction", "scores"])
    return rows.mapInArrow(run, f"`{key}` {kind}, `{label}` int, prediction int, scores array<double>")
