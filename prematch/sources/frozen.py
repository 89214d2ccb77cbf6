"""Listings that are read page by page: a frozen, range-partitioned copy whose pages open only the parts they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS = 100_000


def freeze(df: DataFrame, path: str, keys: list[str], part_rows: int = PART_ROWS) -> None:
    """Write the rows in the order of ``keys`` as parts of about ``part_rows`` rows, and an index of their first and last keys.

    What is written is the boundary: rows that arrive later are not in it, so every page of one walk sees the same listing. Keys must tell
    the rows apart; nulls come first. A part is one folder, and equal keys never straddle two.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // part_rows))
    ranged = df.repartitionByRange(parts, *[F.col(k).asc_nulls_first() for k in keys])
    ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *[F.col(k).asc_nulls_first() for k in keys]).write.partitionBy("part").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows") if parts and df.limit(1).count() else df.withColumn("part", F.lit(0)).limit(0)
    key = F.struct(*keys)
    rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/index")


def page_rows(spark: SparkSession, path: str, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame | None:
    """The next ``limit + 1`` rows after a key, from the one or two parts that hold them (more only where parts are smaller than a page)."""
    index = spark.read.parquet(f"{path}/index")
    kinds = index.schema["first"].dataType
    cursor = None if after is None else F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, kinds.fields)])
    open_parts = index if cursor is None else index.filter(F.col("last") > cursor)
    # every part after the first lies wholly behind the cursor, and none is empty: at most limit + 2 entries are needed
    chosen, sure = [], 0
    for entry in open_parts.orderBy("first").limit(limit + 2).select("part", "rows").collect():
        chosen.append(entry["part"])
        sure += entry["rows"] if len(chosen) > 1 or cursor is None else 0
        if sure > limit:
            break
    if not chosen:
        return None
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/part={p}" for p in chosen]).drop("part")
    rows = rows if cursor is None else rows.filter(F.struct(*keys) > cursor)
    return rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(limit + 1)


def listing_page(spark: SparkSession, path: str, keys: list[str], limit: int, after: tuple | None = None) -> tuple[list, tuple | None]:
    """(rows, next cursor): one page, and where the next one starts; None where there is none."""
    rows = page_rows(spark, path, keys, limit, after)
    got = [] if rows is None else rows.collect()  # limit + 1 rows at most
    return got[:limit], tuple(got[limit - 1][k] for k in keys) if len(got) > limit else None
