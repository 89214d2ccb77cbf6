"""Point-in-time reads: latest, first, previous and interval values as of a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.common import compact_codes, micros
from .skew import HOT_ROWS, last_value_as_of, rolling

# Reasons a feature can be missing.
UPSTREAM, INTEGRITY, STALE, PRECISION, NO_HISTORY = (
    "upstream_unavailable", "temporal_integrity", "stale", "temporal_precision", "no_history",
)


def is_safe(available_at: str = "available_at", risk: str = "leakage_risk") -> Column:
    return F.col(available_at).isNotNull() & (F.col(risk) == "safe")


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                payload: list[str], tie: list[str] = (), strict: bool = False, out: str = "obs",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach the latest right row at or before each left row's time (before it when strict).

    Both sides go through one shuffle as a union; there is no row-by-row pairing. Ties at one time
    are broken by the ``tie`` columns, the larger winning. ``out`` is a struct of the payload, null
    where nothing qualifies.
    """
    tie = list(tie)
    left_side, right_side = ("0", "1") if strict else ("1", "0")
    carried = F.struct(*payload)
    r = right.filter(F.col(right_time).isNotNull()).select(
        *keys, micros(right_time).alias("__t"), F.lit(right_side).alias("__side"),
        *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie)], carried.alias(out),
    )
    r = r.withColumn("__row", F.lit(None).cast(left.schema))
    row = F.struct(*[F.col(c) for c in left.columns])
    lhs = left.select(
        *keys, micros(left_time).alias("__t"), F.lit(left_side).alias("__side"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(tie)],
        F.lit(None).cast(r.schema[out].dataType).alias(out), row.alias("__row"),
    )
    order = ["__t", "__side", *[f"__tie{i}" for i in range(len(tie))]]
    both = lhs.unionByName(r)
    known = last_value_as_of(both, keys, order, out, F.col("__t"), "__known", hot_rows)
    return known.filter(F.col("__row").isNotNull()).select("__row.*", F.col("__known").alias(out))


def asof_with_reason(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, payload: list[str],
                     tie: list[str] = (), max_age_days: float | None = None, out: str = "obs",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """asof_latest over safe, published rows plus ``<out>_reason`` telling why a value is missing."""
    payload = list(dict.fromkeys([*payload, "available_at"]))
    usable = right.filter(is_safe())
    joined = asof_latest(left, usable, keys, left_time, "available_at", payload, tie, False, out, hot_rows)
    seen = right.select(*keys).distinct().withColumn("__seen", F.lit(True))
    joined = joined.join(seen, keys, "left")
    age = micros(left_time) - micros(F.col(out)["available_at"])
    stale = F.lit(False) if max_age_days is None else age > F.lit(int(max_age_days * 86_400_000_000))
    reason = (
        F.when(F.col(out).isNotNull() & ~stale, F.lit(None).cast("string"))
        .when(F.col(out).isNotNull(), F.lit(STALE))
        .when(F.col("__seen"), F.lit(INTEGRITY))
        .otherwise(F.lit(UPSTREAM))
    )
    value = F.when(F.col(out).isNotNull() & ~stale, F.col(out))
    return joined.withColumn(f"{out}_reason", reason).withColumn(out, value).drop("__seen")


def latest_per(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the last in the given order. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def latest_per_as_of(df: DataFrame, keys: list[str], cutoff: str, tie: list[str] = ()) -> DataFrame:
    """Latest safe row per key and sub-key among rows that carry their reader's cutoff."""
    eligible = df.filter(is_safe() & (F.col("available_at") <= F.col(cutoff)))
    return latest_per(eligible, keys, ["available_at", *tie])


def first_and_last(df: DataFrame, keys: list[str], order: list[str], payload: list[str],
                   extra: list[Column] = ()) -> DataFrame:
    """Opening and latest row per key from one aggregate (partial results combine map-side)."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("opening"),
        F.max_by(F.struct(*payload), F.struct(*order)).alias("latest"),
        *extra,
    )


def previous_publication(df: DataFrame, keys: list[str], payload: list[str], tie: list[str] = (),
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach ``prev``: the adjacent earlier safe publication, kept only when its source is the same."""
    wanted = list(dict.fromkeys([*payload, "source", "available_at"]))
    safe = df.filter(is_safe())
    order = ["available_at", *tie]
    rolled = rolling(safe, keys, order, 1, micros("available_at"),
                     {"prev": (F.last(F.struct(*wanted)), -1, -1)}, hot_rows)
    return rolled.withColumn("prev", F.when(F.col("prev.source") == F.col("source"), F.col("prev")))


def duplicate_publications(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that publish more than once at one instant."""
    published = df.filter(F.col("available_at").isNotNull())
    return published.groupBy(*keys, "available_at").agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def interval_as_of(facts: DataFrame, releases: DataFrame, keys: list[str], fact_date: str, cutoff: str,
                   out: str = "member", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Value valid on the fact's date according to the latest release published by its cutoff.

    Releases carry ``release_id``, ``available_at`` and ``periods`` (array of value, valid_from,
    valid_to with an exclusive, possibly open end). A release replaces the whole earlier timeline.
    """
    joined = asof_latest(facts, releases, keys, cutoff, "available_at", ["release_id", "periods"],
                         ["release_id"], False, "__rel", hot_rows)
    inside = F.filter(
        F.col("__rel.periods"),
        lambda p: (p["valid_from"] <= F.col(fact_date)) & (p["valid_to"].isNull() | (F.col(fact_date) < p["valid_to"])),
    )
    return (
        joined.withColumn(out, F.try_element_at(inside, F.lit(1))["value"])
        .withColumn(f"{out}_release", F.col("__rel.release_id"))
        .drop("__rel")
    )


def period_violations(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Empty or overlapping validity periods inside one release."""
    w = Window.partitionBy(*keys).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    following = F.lead("valid_from").over(w)
    codes = compact_codes({
        "empty_period": F.col("valid_to") <= F.col("valid_from"),
        "overlaps_next": following.isNotNull() & (F.col("valid_to").isNull() | (following < F.col("valid_to"))),
    })
    return periods.withColumn("violations", codes).filter(F.size("violations") > 0)


def published_by(df: DataFrame, cutoff) -> DataFrame:
    """Cut an observation table to what was published by a cutoff."""
    return df.filter(F.col("available_at").isNotNull() & (F.col("available_at") <= F.lit(cutoff).cast("timestamp")))


def lineage_leaks(features: DataFrame, records: DataFrame, lineage: str = "lineage", cutoff: str = "prediction_time",
                  record_key: str = "match_id", eligible: str = "eligible_at") -> DataFrame:
    """References of a feature row that were not yet eligible at that row's own cutoff."""
    refs = features.select("*", F.explode(lineage).alias("__ref"))
    source = records.select(F.col(record_key).alias("__ref"), F.col(eligible).alias("ref_eligible_at"))
    joined = refs.join(source, "__ref", "left")
    return joined.filter(F.col("ref_eligible_at").isNull() | (F.col("ref_eligible_at") > F.col(cutoff))).withColumnRenamed(
        "__ref", "reference"
    )


# Statuses that close a fixture.
CLOSED_STATUSES = (
    "complete", "completed", "final", "full time", "ft", "played", "cancelled", "canceled", "postponed",
)


def upcoming_fixtures(fixtures: DataFrame, as_of: str, from_date: str | None = None, through_date: str | None = None,
                      include_placeholders: bool = False) -> DataFrame:
    """Fixtures still open for forecasting; columns match_date, kickoff_at, status, home_team, away_team."""
    now = F.lit(as_of).cast("timestamp")
    start = F.lit(from_date).cast("date") if from_date else now.cast("date")
    keep = F.col("match_date") >= start
    if from_date is None:
        keep = keep & (F.col("kickoff_at").isNull() | (F.col("kickoff_at") > now))
    if through_date is not None:
        keep = keep & (F.col("match_date") <= F.lit(through_date).cast("date"))
    status = F.lower(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    keep = keep & ~status.isin(*CLOSED_STATUSES)
    if not include_placeholders:
        for side in ("home_team", "away_team"):
            keep = keep & ~F.lower(F.coalesce(F.col(side), F.lit(""))).rlike("tbd|to be determined")
    return fixtures.filter(keep)


def cutoff_violations(contexts: DataFrame) -> DataFrame:
    """Prediction times after an exact kickoff, or not before the day of a date-only match."""
    late = F.col("kickoff_at").isNotNull() & (F.col("prediction_time") > F.col("kickoff_at"))
    same_day = F.col("kickoff_at").isNull() & (F.to_date("prediction_time") >= F.col("match_date"))
    return contexts.withColumn(
        "violations", compact_codes({"after_kickoff": late, "not_before_match_date": same_day})
    ).filter(F.size("violations") > 0)
