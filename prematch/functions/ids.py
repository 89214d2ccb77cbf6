"""Deterministic identities (B8) and order-free table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


def digest(*parts: Column | str, length: int = 64) -> Column:
    joined = F.concat_ws("|", *[F.trim(col(p).cast("string")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def source_row_id(source: Column | str, *parts: Column | str) -> Column:
    return F.concat(col(source), F.lit(":"), digest(source, *parts, length=20))


def canonical_match_id(match_date, home_team_id, away_team_id, competition_id) -> Column:
    return digest(match_date, home_team_id, away_team_id, competition_id, length=20)


def content_id(prefix: str, payload: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(col(payload), 256))


def fingerprint(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Content identity of a table that does not depend on row order or partitioning.

    Each row hashes to 256 bits; the sums of its eight 32-bit words are commutative, so partial sums
    combine map-side and a few numbers per task are shuffled.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    hashed = df.select(*(group or []), row.alias("__h"))
    words = [F.conv(F.substring("__h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]
    return hashed.groupBy(*(group or [])).agg(F.count("*").alias("row_count"), F.concat_ws("-", *sums).alias("content_sum"))
