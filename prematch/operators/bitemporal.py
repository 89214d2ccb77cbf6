"""Append-only records read as of a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_per


def _moment(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def visible(records: DataFrame, as_of, through_sequence: int | None = None, kind: str | None = None) -> DataFrame:
    """Rows both published and recorded by a moment, up to an optional sequence boundary."""
    moment = _moment(as_of)
    rows = records.filter((F.col("available_at") <= moment) & (F.col("recorded_at") <= moment))
    if through_sequence is not None:
        rows = rows.filter(F.col("sequence") <= through_sequence)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def latest_as_of(records: DataFrame, as_of, through_sequence: int | None = None, kind: str | None = None) -> DataFrame:
    """Current revision of every (kind, entity): newest by recording time, then sequence."""
    return latest_per(visible(records, as_of, through_sequence, kind), ["kind", "entity_id"], ["recorded_at", "sequence"])


def page(current: DataFrame, limit: int, after=None) -> DataFrame:
    """One keyset page of entities; one extra row decides whether there is a next page."""
    rows = current if after is None else current.filter(F.col("entity_id") > F.lit(after))
    probe = rows.orderBy("entity_id").limit(limit + 1)
    # at most limit + 1 rows are numbered here
    from pyspark.sql import Window

    w = Window.orderBy("entity_id")
    numbered = probe.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count("*").over(Window.partitionBy()))
    cursor = F.max(F.when(F.col("__n") == limit, F.col("entity_id"))).over(Window.partitionBy())
    out = numbered.withColumn("truncated", F.col("__all") > limit).withColumn("next_cursor", F.when(F.col("__all") > limit, cursor))
    return out.filter(F.col("__n") <= limit).drop("__n", "__all")


def history_page(records: DataFrame, kind: str, entity_id, as_of, after_sequence: int, through_sequence: int,
                 limit: int) -> DataFrame:
    """Revisions of one entity in commit order inside a frozen boundary."""
    rows = visible(records, as_of, through_sequence, kind)
    rows = rows.filter((F.col("entity_id") == F.lit(entity_id)) & (F.col("sequence") > after_sequence))
    return rows.orderBy("sequence").limit(limit)


def record_id() -> Column:
    """Content address of a record."""
    return F.concat(F.lit("record_"), F.sha2(F.concat_ws(
        "|", F.col("kind"), F.col("entity_id").cast("string"), F.unix_micros("available_at").cast("string"),
        F.unix_micros("recorded_at").cast("string"), F.col("payload")), 256))


def resolve_references(refs: DataFrame, records: DataFrame, as_of) -> DataFrame:
    """Exact revisions named by references (role, record_id, expected_kind, expected_entity), with a status.

    A record that is stored several times has one id and one content, so a reference finds it once.
    """
    found = visible(records, as_of).select(
        "record_id", F.col("kind").alias("found_kind"), F.col("entity_id").alias("found_entity"), "recorded_at").dropDuplicates(["record_id"])
    joined = refs.join(found, "record_id", "left")
    status = (
        F.when(F.col("found_kind").isNull(), F.lit("unavailable"))
        .when(F.col("found_kind") != F.col("expected_kind"), F.lit("kind_mismatch"))
        .when(F.col("expected_entity").isNotNull() & (F.col("found_entity") != F.col("expected_entity")), F.lit("entity_mismatch"))
        .otherwise(F.lit("resolved"))
    )
    return joined.withColumn("status", status)


def new_records(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming records not stored yet, each content once."""
    addressed = incoming if "record_id" in incoming.columns else incoming.withColumn("record_id", record_id())
    return addressed.dropDuplicates(["record_id"]).join(stored.select("record_id"), "record_id", "left_anti")


def integrity_mismatches(records: DataFrame) -> DataFrame:
    """Stored records whose content no longer gives their id."""
    return records.withColumn("expected_id", record_id()).filter(F.col("expected_id") != F.col("record_id"))
