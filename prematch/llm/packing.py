"""Pack tokenized documents into as few training sequences as possible."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, small_side, stored, text_batches
from .grouped_packing import GROUPS, Bins, pack_lengths
from .vocabularies import byte_level, public_path

CAPACITY = 2048
END = 0                 # id after every document
OFFSET_ROWS = 200_000   # (task, length) offsets broadcast up to here, joined by a shuffle beyond


def _pieces(batches, path, capacity, end):
    encoder = byte_level(path, False)
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc, piece, start, length, tokens, place = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array([*encoder.encode(text or ""), end], "<u4")
            first = (len(ids) - 1) % capacity + 1
            edges = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                doc.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                tokens.append(ids[a:b].tobytes())
                place.append(seen[b - a])
                seen[b - a] += 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(tokens, pa.binary()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place, pa.int64())],
            names=["doc_id", "piece", "start", "length", "tokens", "task", "place"])


def document_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Token ids of every document, cut to ``capacity``: doc_id, piece, start, length, tokens (little-endian unsigned 32-bit ids), and
    place, the number of earlier pieces of the same length in the same task. Only the first piece of a document can be shorter than the rest."""
    text_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + T.StructType.fromDDL("piece int, start long, length long, tokens binary, task int, place long").fields)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: _pieces(batches, path, capacity, end), schema)


def slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go. A row stands for the pieces of one length from rank ``first`` on: ``each`` of them in a row
    from ``offset`` in every sequence from ``sequence`` on. Sorted by (length, first)."""
    rows, used, sequence = [], defaultdict(int), 0
    for b in bins:
        offset = 0
        for length, each in b.content:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * b.times
            offset += length * each
        sequence += b.times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def _locate(table: dict[str, np.ndarray]):
    bounds = np.searchsorted(table["length"], np.arange(int(table["length"].max(initial=0)) + 2))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, number = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.zeros(len(size), np.int64)
        for value in np.unique(size):
            mine, low = size == value, bounds[value]
            row[mine] = low + np.searchsorted(table["first"][low:bounds[value + 1]], number[mine], "right") - 1
        nth = number - table["first"][row]
        return pd.DataFrame({"sequence_id": table["sequence"][row] + nth // table["each"][row], "offset": table["offset"][row] + nth % table["each"][row] * size})

    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, tokens, sequence_id and offset. Pieces of a sequence lie gapless from 0.

    The driver sees how many pieces have each length (at most ``capacity`` numbers) and returns which ranks of a length go where;
    a piece finds its place by its rank among those of its length, which is its place in its task plus the counts of earlier tasks.
    A length that most documents share is thus spread like any other. Pieces are written once, so ranks survive a lost executor.

    Null or empty text: the end id alone. Repeated rows, equal or null doc_ids: each row is packed by itself. Ties: by place. No rows: no
    rows. A very long text: one row per piece of ``capacity`` ids. Columns other than doc_id and text are not read. Strings of special
    tokens in a text become those tokens.
    """
    spark = docs.sparkSession
    pieces = stored(document_pieces(docs, path or public_path("byte_bpe_50k.json"), capacity, end), compression="zstd")
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pack_lengths(histogram, capacity, groups)))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return _locate(table.value)(length, rank)

    return (pieces.join(small_side(before, OFFSET_ROWS), ["task", "length"])
            .withColumn("at", locate("length", F.col("place") + F.col("before")))
            .select("doc_id", "piece", "start", "length", "tokens", "at.sequence_id", "at.offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and tokens, the concatenation of its pieces (at most the capacity)."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "tokens")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda whole, part: F.concat(whole, part["tokens"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("tokens"))


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(read_table(spark, folder, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
