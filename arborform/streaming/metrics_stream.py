"""F8 and F9 over a stream of scored positions, in state kept by batch.

A batch of n sequences is a key. Its state, small and of a fixed bound (n
sequences, k x k counts), holds the sequences seen, and for every label and
prediction their count and loss sum. Each micro-batch adds its rows and sends the
whole state of the batches it touched, so the newest rows of a batch say all about
it, and a replayed micro-batch, which overwrites its own folder, changes nothing.

Late rows. A batch is closed once the watermark has passed its latest event by
``keep_open``: its state is sent once more, marked closed, and dropped. Rows
older than the watermark are not counted (Spark's progress reports them as
``numRowsDroppedByWatermark``); younger rows of a closed batch open it anew, under
the next version, and are added to what was closed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import hand_back, ship_package_by_value
from ..operators.metrics import IGNORE, argmax, evaluate_counts, row_loss

STATE = "version bigint, seqs array<bigint>, labels array<int>, preds array<int>, counts array<bigint>, losses array<double>"
OUT = "batch bigint, version bigint, closed boolean, seqs bigint, label int, pred int, n bigint, loss double"


def scored_rows(tokens: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """(batch, seq, ts, label, pred, loss) of stream rows (batch, seq, ts, logits,
    label); an ignored position keeps its sequence and has no label."""
    on = F.col(label) != F.lit(IGNORE)
    return tokens.select("batch", "seq", "ts", F.when(on, F.col(label)).alias("label"),
                         F.when(on, argmax(F.col(logits))).alias("pred"), F.when(on, row_loss(F.col(logits), F.col(label))).alias("loss"))


def add_rows(kept: tuple | None, rows: pd.DataFrame) -> tuple:
    """State (version, seqs, labels, preds, counts, losses) with the rows added."""
    version, seqs, *lists = kept or (0, [], [], [], [], [])
    sums = {(a, b): (n, s) for a, b, n, s in zip(*lists)}
    some = rows[rows["label"].notna()]
    # one pass for all pairs: a batch has hundreds of them
    new = some.groupby(["label", "pred"], sort=True)["loss"].agg(["size", "sum"])
    for (a, b), more, loss in zip(new.index.tolist(), new["size"].tolist(), new["sum"].tolist()):
        n, s = sums.get((int(a), int(b)), (0, 0.0))
        sums[int(a), int(b)] = (n + more, s + loss)
    keys = sorted(sums)
    return (version, sorted({*seqs, *map(int, rows["seq"].unique())}), [a for a, _ in keys], [b for _, b in keys],
            [sums[k][0] for k in keys], [sums[k][1] for k in keys])


def shown(batch: int, state: tuple, closed: bool) -> pd.DataFrame:
    """Output rows of a state; one without labels if it has no scored position."""
    version, seqs, labels, preds, counts, losses = state
    n = max(1, len(labels))
    fill = lambda v: list(v) or [None]
    return pd.DataFrame({"batch": [batch] * n, "version": [version] * n, "closed": [closed] * n, "seqs": [len(seqs)] * n, "label": pd.array(fill(labels), "Int32"),
                         "pred": pd.array(fill(preds), "Int32"), "n": fill(counts) if labels else [0], "loss": fill(losses) if labels else [0.0]})


def metric_stream(stream: DataFrame, out_dir: str, checkpoint: str, delay: str = "10 minutes", keep_open: int = 600_000):
    """Start the query: stream rows (batch, seq, ts, logits, label) -> state rows in
    ``out_dir``. ``delay``: of the watermark; ``keep_open``: milliseconds."""
    ship_package_by_value()

    def update(key, parts, state):
        batch = int(key[0])
        if batch % 64 == 0:
            hand_back()
        kept = state.get if state.exists else None
        if state.hasTimedOut:
            yield shown(batch, kept, True)
            # what comes later is a version of its own
            state.remove()
            return
        latest = 0
        for part in parts:
            if kept is None:
                kept = (int(part["ts"].max().value // 1_000_000), [], [], [], [], [])
            kept = add_rows(kept, part)
            latest = max(latest, int(part["ts"].max().value // 1_000_000))
        state.update(kept)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_open)
        yield shown(batch, kept, False)
    rows = scored_rows(stream).withWatermark("ts", delay)
    states = rows.groupBy("batch").applyInPandasWithState(update, OUT, STATE, "update", "EventTimeTimeout")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
    return states.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint).start()


def stream_metrics(spark: SparkSession, out_dir: str, average: str = "weighted") -> DataFrame:
    """The metric row (F9) of all that the stream has counted so far."""
    rows = spark.read.parquet(out_dir)
    newest = F.max("batch_id").over(Window.partitionBy("batch", "version"))
    now = rows.withColumn("newest", newest).filter("batch_id = newest")
    sizes = now.select("batch", "version", "seqs").distinct().groupBy("batch").agg(F.sum("seqs").alias("seqs"))
    sums = now.filter("label is not null").groupBy("batch", "label", "pred").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return evaluate_counts(sizes, sums, average)
