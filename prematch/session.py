"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK, LEAST_ROWS = 1_000_000, 25_000  # bounds of a task's share of a table that an optimiser reads

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prematch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PREMATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the options the operators rely on in a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a scratch one only in a local session where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        import tempfile

        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared checkpoint folder: for what is large and read by many passes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The same rows dealt evenly over two tasks per core, more for large tables and fewer for small ones.

    The last join of a plan leaves as few partitions as its bytes fill, and a written table one row group per partition; every later
    pass over that table would run in as few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(2 * cores, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / ROWS_PER_TASK)))
