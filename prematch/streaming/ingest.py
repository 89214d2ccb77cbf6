"""Incremental arrival: new source rows flow into the append-only record table, each content once.

Which records are stored is kept as keyed state beside the stream's checkpoint (RocksDB), so a micro-batch looks up its own ids and never
reads the table. A batch is written under its number and becomes visible with its commit entry: a batch that was stopped half-way
is invisible and is written anew under the same number when the stream goes on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitemporal import record_id

RECORD_SCHEMA = (
    "sequence BIGINT, kind STRING, entity_id STRING, record_id STRING, available_at TIMESTAMP, recorded_at TIMESTAMP, payload STRING"
)
INCOMING_SCHEMA = "sequence BIGINT, kind STRING, entity_id STRING, available_at TIMESTAMP, recorded_at TIMESTAMP, payload STRING"
COMMIT_SCHEMA = "rows BIGINT, committed_at TIMESTAMP, batch BIGINT"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, table: str) -> DataFrame:
    """One row per batch that is visible: its number, rows and time."""
    return _read(spark, COMMIT_SCHEMA, f"{table}/commits")


def stored_records(spark: SparkSession, table: str) -> DataFrame:
    """The records of committed batches. ``batch`` is a partition column, so other batches are not opened."""
    data = _read(spark, f"{RECORD_SCHEMA}, batch BIGINT", f"{table}/data")
    return data.join(F.broadcast(commits(spark, table).select("batch")), "batch", "left_semi").drop("batch")


def commit_batch(batch: DataFrame, number: int, table: str) -> None:
    """Write a batch aside, replacing what an earlier try under this number left, and make it visible."""
    spark = batch.sparkSession
    batch.select(*[c.split()[0] for c in RECORD_SCHEMA.split(", ")]).write.mode("overwrite").partitionBy("kind").parquet(f"{table}/data/batch={number}")
    rows = spark.read.parquet(f"{table}/data/batch={number}").count() if not batch.isEmpty() else 0
    entry = spark.range(1).select(F.lit(rows).cast("bigint").alias("rows"), F.current_timestamp().alias("committed_at"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/batch={number}")


def ingest_stream(spark: SparkSession, source: str, table: str, checkpoint: str):
    """Process every file now present under ``source`` and stop; call again, with the same checkpoint, when more has arrived.

    A record that was stored before, in this run or an earlier one, adds nothing. A table belongs to one checkpoint.
    """
    fresh = spark.readStream.schema(INCOMING_SCHEMA).json(source).withColumn("record_id", record_id()).dropDuplicates(["record_id"])
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        return (
            fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, number: commit_batch(batch, number, table)).start()
        )
    finally:
        spark.conf.set(STATE_STORE[0], before)
