"""Helpers shared by the operators on training text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed value: a word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_digest(text: Column) -> Column:
    """Stands for a text in keys; a null text has a digest of its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def row_key(doc_id: Column, text: Column) -> Column:
    """One string per distinct (doc_id, text), nulls included: joins what was found back to the rows it was found in."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_digest(text))


def written(df: DataFrame) -> DataFrame:
    """The same rows from the cluster's shared checkpoint folder: computed once, and not lost with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Like written, as a compressed table in the same folder: for what is large."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Marked for broadcast if it has at most max_rows rows; left to Spark's choice of join otherwise."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, for a helper beside the user's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand texts to Python in small batches, so that very long ones fit a worker's memory together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
