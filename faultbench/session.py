"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import gc
import os
from itertools import count

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    *,
    app_name: str = "faultbench",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings the library relies on (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Small shuffles keep some parallelism instead of collapsing to one task;
        # irrelevant at scale, where partitions are far larger than this.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go when the DataFrames that read them do.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where a local session has none
    (tests, a shell), a folder in its warehouse is taken; a cluster must name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set(CHECKPOINT_CONF, configured)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of DataFrames that are gone.

    It does so when the driver's garbage collection has found them, which may be long after on a driver with
    little else to do (``spark.cleaner.periodicGC.interval``).
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{spark.sparkContext.applicationId}-{os.getpid()}-{next(_counter)}"


def recommended_conf(total_input_bytes: int, *, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a given input volume.

    Shuffle partitions are sized so that a partition of the largest shuffle (about
    the stacked input) stays near ``target_partition_bytes``; AQE coalesces them when
    the data is smaller and splits skewed ones.
    """
    parts = max(200, total_input_bytes // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


_counter = count(1)
