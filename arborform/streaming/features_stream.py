"""Feature rows for texts arriving as a file stream.

The steps after the leaf walk are per row, so a stream needs no state: each
micro-batch runs the same batch plan (walk, cut, align, broadcast
vocabulary join, one grouping by key) and writes its feature rows to
``<sink>/batch_id=<id>/split=<split>/``. The checkpoint location makes the
query restartable, and since a replayed batch overwrites its own folder the
sink holds each batch once (read the sink folder for all rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import features
from ..operators.shape import exclude_lang

DOC_SCHEMA = "doc_id long, text string, lang string, split string"


def feature_stream(spark: SparkSession, src_dir: str, vocab: DataFrame, out_dir: str,
                   checkpoint: str, length: int = 512, exclude: str | None = None,
                   vocab_rows: int | None = None, schema: str = DOC_SCHEMA,
                   max_files_per_trigger: int = 64):
    """Start a streaming query: parquet texts in ``src_dir`` -> feature rows
    in ``out_dir``. Returns the StreamingQuery. ``vocab`` is a static frame
    (build it once with ``build_vocab`` and keep it bounded)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                   .parquet(src_dir))
    if exclude is not None:
        stream = exclude_lang(stream, exclude)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        f = features(batch.select("doc_id", "text"), vocab, "doc_id", "text", length,
                     vocab_rows=vocab_rows)
        splits = batch.select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))
        # one folder per batch id, overwritten: a batch replayed after a
        # failure replaces its own output instead of adding a second copy
        (f.join(splits, "doc_id").write.mode("overwrite").partitionBy("split")
          .parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(write_batch)
                  .option("checkpointLocation", checkpoint).start())
