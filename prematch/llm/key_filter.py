"""A filter of 64-bit keys with a bounded number of bits, put together by Spark and handed to every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_BITS, MAX_BITS = 16, 28   # the filter has 2**16 to 2**28 bits (32 MB); a full one only lets more keys through
BITS_A_KEY = 16
PIECE = 16                    # log2 of the bits that one group puts together


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for all keys of the filter, and by chance for some others."""
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def key_filter(keys: DataFrame, column: str, n_keys: int):
    """Broadcast bits of the keys in a long column whose values are well mixed. ``n_keys`` sets the size up to the bound; the driver
    holds the bits and never the keys."""
    size = min(max(MIN_BITS, int(BITS_A_KEY * max(n_keys, 1)).bit_length()), MAX_BITS)

    def places(batches):
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << size) - 1)).astype(np.int64)
            at = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(at >> PIECE), pa.array(at & ((1 << PIECE) - 1))], names=["piece", "at"])

    def put(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << PIECE, np.uint8)
        marks[table["at"].to_numpy()] = 1
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(1 << (size - 3), np.uint8)
    width = 1 << (PIECE - 3)
    marked = keys.select(column).mapInArrow(places, "piece long, at long").distinct()
    for row in marked.groupBy("piece").applyInArrow(put, "piece long, bits binary").toLocalIterator():
        whole[row["piece"] * width:(row["piece"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)
