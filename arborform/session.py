"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "arborform",
                shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster leave ``master`` unset so spark-submit decides; the
    shuffle-partition count should then be sized from the input
    (roughly input bytes / 128 MB) by the caller.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or an earlier
    ``setCheckpointDir``). Only a local-mode session without one gets a
    fresh scratch folder, as in tests; a cluster session without one is
    an error, because a machine-local folder does not survive executor loss.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the setting)
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="arborform-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def fresh_subdir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder (for written tables)."""
    base = shared_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start
    from the files, and a lost executor re-reads them."""
    path = fresh_subdir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
