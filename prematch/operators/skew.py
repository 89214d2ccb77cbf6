"""Windows and as-of reads that stay parallel when one key holds a large share of the rows.

A window partitioned by key puts a whole key in one task. The operators here count rows per key
first (a map-side combined aggregate on the key columns only). Keys above ``hot_rows`` are cut into
time chunks and windows are partitioned by (key, chunk); what a chunk needs from earlier chunks is
computed from per-chunk summaries of bounded size and put back as extra rows. Results are identical
to the plain window for every choice of ``hot_rows``. At most ``rows / hot_rows`` keys can be hot,
which bounds the broadcast of the hot-key table.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

HOT_ROWS = 4_000_000
CHUNKS_PER_LIMIT = 8
CHUNK, HOT, HALO, WANTED = "__chunk", "__hot", "__halo", "__wanted"


def hot_keys(df: DataFrame, keys: list[str], time: Column, hot_rows: int) -> DataFrame | None:
    """Row count and time range of the keys above the limit; None when there are none."""
    stats = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__n"), F.min(time).alias("__lo"), F.max(time).alias("__hi"))
        .filter(F.col("__n") > hot_rows)
    )
    return None if stats.isEmpty() else stats


def assign_chunks(df: DataFrame, keys: list[str], time: Column, hot_rows: int) -> tuple[DataFrame, bool]:
    """Add chunk and hot columns; time is a numeric column that follows the window order."""
    stats = hot_keys(df, keys, time, hot_rows)
    if stats is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long")).withColumn(HOT, F.lit(False)), False
    pieces = F.ceil(F.col("__n") / F.lit(hot_rows)) * CHUNKS_PER_LIMIT
    width = F.greatest(F.lit(1.0), (F.col("__hi") - F.col("__lo")) / pieces)
    chunk = F.coalesce(F.floor((time - F.col("__lo")) / width), F.lit(0)).cast("long")
    split = (
        df.join(F.broadcast(stats), keys, "left")
        .withColumn(CHUNK, chunk)
        .withColumn(HOT, F.col("__n").isNotNull())
        .drop("__n", "__lo", "__hi")
    )
    return split, True


def with_halo(df: DataFrame, keys: list[str], order: list[str], depth: int, time: Column,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add __chunk and __halo so that frames reaching ``depth`` rows back are exact per (keys, chunk).

    Halo rows are copies of the last ``depth`` rows before a chunk; drop them after the window.
    """
    split, any_hot = assign_chunks(df, keys, time, hot_rows)
    if not any_hot:
        return split.drop(HOT).withColumn(HALO, F.lit(False))
    columns = df.columns
    hot = split.filter(HOT)
    last = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tails = hot.withColumn("__r", F.row_number().over(last)).filter(F.col("__r") <= depth)
    per_chunk = tails.groupBy(*keys, CHUNK).agg(
        F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v")))).alias("tail")
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-depth, -1)
    earlier = F.flatten(F.collect_list("tail").over(before))
    halo = (
        per_chunk.select(*keys, CHUNK, F.slice(earlier, F.greatest(F.size(earlier) - depth + 1, F.lit(1)), depth).alias("h"))
        .select(CHUNK, F.explode("h").alias("h"))
        .select(F.col(CHUNK), F.col("h.v.*"))
        .withColumn(HALO, F.lit(True))
    )
    return split.drop(HOT).withColumn(HALO, F.lit(False)).unionByName(halo)


def rolling(df: DataFrame, keys: list[str], order: list[str], depth: int, time: Column,
            exprs: dict[str, tuple[Column, int, int]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Evaluate aggregates over row frames; exprs maps name -> (aggregate, first offset, last offset)."""
    haloed = with_halo(df, keys, order, depth, time, hot_rows)
    base = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    added = haloed.select("*", *[agg.over(base.rowsBetween(lo, hi)).alias(n) for n, (agg, lo, hi) in exprs.items()])
    return added.filter(~F.col(HALO)).drop(HALO, CHUNK)


def running_top_n(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, time: Column,
                  out: str, hot_rows: int = HOT_ROWS, wanted: Column | None = None) -> DataFrame:
    """For each row, the n largest non-null values up to and including it, largest first.

    Each key is read once in its order and the state is n values, whatever the key's size; nothing pairs
    rows with rows or holds a key's rows. ``wanted`` tells which rows to return, by default all.
    """
    columns = df.columns
    marked = df.withColumn(WANTED, F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False)))
    split, any_hot = assign_chunks(marked, keys, time, hot_rows)
    if not any_hot:
        return _scan_top(split, [*keys], order, value, n, out).select(*columns, out)
    hot = split.filter(HOT)
    best = Window.partitionBy(*keys, CHUNK).orderBy(F.col(value).desc())
    summary = (
        hot.filter(F.col(value).isNotNull())
        .withColumn("__r", F.row_number().over(best))
        .filter(F.col("__r") <= n)
        .select(*keys, CHUNK, F.col(value).alias("__v"))
    )
    grid = hot.select(*keys, CHUNK).distinct().withColumn("__v", F.lit(None).cast(df.schema[value].dataType))
    states = _top_slots(grid.unionByName(summary), keys, [CHUNK, "__v"], "__v", n, "__state")
    halo = states.filter(F.col("__v").isNull()).select(*keys, CHUNK, F.explode("__before").alias(value))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (*keys, value)]
    halo = halo.select(*keys, CHUNK, value, *blank, F.lit(False).alias(WANTED)).withColumn(HALO, F.lit(True))
    both = split.drop(HOT).withColumn(HALO, F.lit(False)).unionByName(halo)
    return _scan_top(both, [*keys, CHUNK], [f"{HALO} DESC", *order], value, n, out).select(*columns, out)


def _ordering(order: list[str]) -> list[Column]:
    return [F.col(o[:-5]).desc() if o.endswith(" DESC") else F.col(o).asc_nulls_first() for o in order]


def _ranks(values: pa.Array) -> np.ndarray:
    """Place of every value in ascending order; structs compare field by field, nulls first."""
    columns = []

    def flatten(array: pa.Array) -> None:
        if pa.types.is_struct(array.type):
            for part in array.flatten():
                flatten(part)
        else:
            columns.append(array)

    flatten(values)
    names = [f"c{i}" for i in range(len(columns))]
    places = pc.sort_indices(pa.table(columns, names=names), sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
    ranks = np.empty(len(places), np.int64)
    ranks[places] = np.arange(len(places))
    return ranks


def _key_starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """True where a row's key is not that of the row before; ``last`` is the key before the batch."""
    starts = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(k)
        here, before = c.slice(1), c.slice(0, batch.num_rows - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before)))
        starts[1:] |= differs.to_numpy(zero_copy_only=False)
    starts[0] = last is None or last != tuple(batch.column(k)[0].as_py() for k in keys)
    return starts


def _scan_top(df: DataFrame, partition: list[str], order: list[str], value: str, n: int, out: str) -> DataFrame:
    """The wanted rows of every (sorted) partition with its n largest values so far; batches stream through a task."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + [T.StructField(out, T.ArrayType(df.schema[value].dataType))])

    def scan(batches):
        last, kept = None, None  # the key being read, and its largest values so far, smallest first
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(value)
            present = pc.is_valid(own)
            given = own.filter(present)
            values = given if kept is None else pa.concat_arrays([kept, given])
            held = len(values) - len(given)
            ranks = _ranks(values)
            by_rank = np.argsort(ranks)
            ranks = ranks.tolist()
            top, at, picked, ends = sorted(ranks[:held]), held, [], [0]
            wanted = batch.column(WANTED)
            rows = zip(_key_starts(batch, partition, last).tolist(), present.to_pylist(), wanted.to_pylist())
            for start, has, wants in rows:
                if start:
                    top = []
                if has:
                    rank = ranks[at]
                    at += 1
                    if len(top) < n:
                        bisect.insort(top, rank)
                    elif rank > top[0]:
                        bisect.insort(top, rank)
                        del top[0]
                if wants:
                    picked += top[::-1]
                    ends.append(len(picked))
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in partition)
            kept = values.take(pa.array(by_rank[top], pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(by_rank[picked], pa.int64())))
            shown = batch.filter(wanted)
            yield pa.RecordBatch.from_arrays([*shown.columns, lists], names=[*shown.schema.names, out])

    ordered = df.repartition(*partition).sortWithinPartitions(*partition, *_ordering(order))
    return ordered.mapInArrow(scan, schema)


def _top_slots(df: DataFrame, partition: list[str], order: list[str], value: str, n: int, out: str) -> DataFrame:
    """The same by one window per slot, for the few rows of chunk summaries; ``__before`` is the state before a row.

    Slot k keeps the running maximum of what slot k-1 displaced.
    """
    before = Window.partitionBy(*partition).orderBy(*_ordering(order)).rowsBetween(Window.unboundedPreceding, -1)
    candidate, current = F.col(value), []
    result = df
    for slot in range(n):
        prev = f"__p{slot}"
        result = result.withColumns({f"__c{slot}": candidate, prev: F.max(candidate).over(before)})
        kept, incoming = F.col(prev), F.col(f"__c{slot}")
        current.append(F.greatest(kept, incoming))
        candidate = F.when(kept.isNotNull() & incoming.isNotNull(), F.least(kept, incoming))
    result = result.withColumns({
        out: F.array_compact(F.array(*current)), "__before": F.array_compact(F.array(*[F.col(f"__p{s}") for s in range(n)]))})
    return result.drop(*[f"__p{s}" for s in range(n)], *[f"__c{s}" for s in range(n)])


def last_value_as_of(df: DataFrame, keys: list[str], order: list[str], value: str, time: Column,
                     out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Latest non-null value at or before each row in the given order."""
    split, any_hot = assign_chunks(df, keys, time, hot_rows)
    if not any_hot:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return split.withColumn(out, F.last(value, ignorenulls=True).over(frame)).drop(CHUNK, HOT)
    hot = split.filter(HOT)
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    per_chunk = hot.groupBy(*keys, CHUNK).agg(F.max_by(value, position).alias("__v"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, CHUNK, F.last("__v", ignorenulls=True).over(earlier).alias(value)).filter(
        F.col(value).isNotNull()
    )
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (*keys, value)]
    halo = carry.select(*keys, CHUNK, value, *blank).withColumn(HALO, F.lit(True))
    both = split.drop(HOT).withColumn(HALO, F.lit(False)).unionByName(halo)
    frame = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(F.col(HALO).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    known = both.withColumn(out, F.last(value, ignorenulls=True).over(frame))
    return known.filter(~F.col(HALO)).drop(CHUNK, HALO)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunk: str | None) -> DataFrame:
    """Sum of earlier rows per key (zero for the first). ``chunk`` names a precomputed chunk column, if any key is hot."""
    part = keys if chunk is None else [*keys, chunk]
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
    if chunk is None:
        return summed
    totals = df.groupBy(*part).agg(F.sum(value).alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, F.coalesce(F.sum("__t").over(earlier), F.lit(0.0)).alias("__c"))
    return summed.join(carry, part).withColumn(out, F.col(out) + F.col("__c")).drop("__c")
