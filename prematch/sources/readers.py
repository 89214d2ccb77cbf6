"""Typed tables from source files and raw text frames (A1-A8). Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import compact_codes
from ..functions.ids import source_row_id
from ..functions.probability import outcome_label
from ..functions.text import (
    has_zone, map_status, parse_bool, parse_score, parse_utc, resolve_score_basis, score_is_invalid,
)

# Source columns of the result files.
RESULT_COLUMNS = ("date", "home_team", "away_team", "home_score", "away_score", "tournament", "city", "country", "neutral")


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """CSV with a header, every column as text; a file that lacks a declared column fails."""
    return (
        spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path)
    )


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Source is missing required columns: {missing}")
    return df


def blank_text(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def match_observations(raw: DataFrame, mapping: dict[str, str], source: str, ingested_at: str,
                       status_map: dict[str, str] | None = None, default_status: str = "completed",
                       asserted_basis: str = "unknown", leakage_risk: str = "post_match_only") -> DataFrame:
    """Source rows as typed observations with a ``violations`` array; rejects are the rows where it is not empty.

    mapping maps the contract names (match_date, home_team_name, away_team_name, competition_name,
    neutral and optionally home_score, away_score, status, score_basis, kickoff_at, available_at,
    source_match_id) to source columns.
    """
    require_columns(raw, mapping.values())

    def text(name: str) -> Column:
        return F.trim(F.col(mapping[name])) if name in mapping else F.lit(None).cast("string")

    date = F.try_to_date(text("match_date"), "yyyy-MM-dd")
    home, away = parse_score(text("home_score")), parse_score(text("away_score"))
    status = map_status(text("status"), status_map, default_status) if "status" in mapping else F.lit(default_status)
    basis = resolve_score_basis(text("score_basis"), asserted_basis)
    if "score_basis" not in mapping:
        basis = F.struct(F.lit(asserted_basis).alias("basis"), F.lit(False).alias("conflict"),
                         F.lit(asserted_basis == "regulation_time").alias("usable"))
    neutral = parse_bool(text("neutral"))
    identity = text("source_match_id") if "source_match_id" in mapping else source_row_id(
        F.lit(source), date.cast("string"), text("home_team_name"), text("away_team_name"), text("competition_name"))
    violations = compact_codes({
        "match_date": date.isNull(),
        "home_team_name": blank_text(text("home_team_name")),
        "away_team_name": blank_text(text("away_team_name")),
        "competition_name": blank_text(text("competition_name")),
        "home_score": score_is_invalid(text("home_score")),
        "away_score": score_is_invalid(text("away_score")),
        "neutral": neutral.isNull(),
        "status": status.isNull(),
        "score_basis": basis["conflict"],
        "kickoff_zone": ~blank_text(text("kickoff_at")) & ~has_zone(text("kickoff_at")),
        "unpaired_scores": home.isNull() != away.isNull(),
        "completed_without_score": (status == "completed") & (home.isNull() | away.isNull()),
        "score_without_completion": (status != "completed") & (home.isNotNull() | away.isNotNull()),
        "self_play": F.lower(text("home_team_name")) == F.lower(text("away_team_name")),
    })
    return raw.select(
        "*",
        F.struct(
            identity.alias("source_match_id"), date.alias("match_date"), parse_utc(text("kickoff_at")).alias("kickoff_at"),
            text("home_team_name").alias("home_team_name"), text("away_team_name").alias("away_team_name"),
            text("competition_name").alias("competition_name"), neutral.alias("neutral"), home.alias("home_score"),
            away.alias("away_score"), status.alias("status"), basis["basis"].alias("score_basis"),
            F.struct(
                F.lit(source).alias("source"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
                parse_utc(text("available_at")).alias("available_at"), F.lit(leakage_risk).alias("leakage_risk"),
            ).alias("metadata"),
        ).alias("observation"),
        violations.alias("violations"),
    )


# The preset mapping of plain results files.
PRESET_RESULTS = {
    "match_date": "date", "home_team_name": "home_team", "away_team_name": "away_team",
    "competition_name": "tournament", "neutral": "neutral", "home_score": "home_score", "away_score": "away_score",
}


def preset_results(raw: DataFrame, ingested_at: str) -> DataFrame:
    """Plain results: fixed mapping, completed status, scores never usable before the match."""
    return match_observations(raw, PRESET_RESULTS, "historical_results", ingested_at)


def historical_results(raw: DataFrame) -> DataFrame:
    """Validated, trimmed, typed results with their outcome label and a violations array."""
    require_columns(raw, ("date", "home_team", "away_team", "home_score", "away_score", "tournament", "neutral"))
    home, away = parse_score("home_score"), parse_score("away_score")
    date = F.try_to_date(F.trim("date"), "yyyy-MM-dd")
    typed = raw.select(
        *[c for c in raw.columns if c not in ("date", "home_team", "away_team", "home_score", "away_score", "tournament", "neutral")],
        date.alias("match_date"), F.trim("home_team").alias("home_team"), F.trim("away_team").alias("away_team"),
        home.alias("home_score"), away.alias("away_score"), F.trim("tournament").alias("tournament"),
        parse_bool("neutral").alias("neutral"),
        (F.trim("home_score").like("-%") | F.trim("away_score").like("-%")).alias("__neg"),
    )
    return typed.withColumn("outcome", outcome_label("home_score", "away_score")).withColumn("violations", compact_codes({
        "bad_date": F.col("match_date").isNull(),
        "blank_team": blank_text(F.col("home_team")) | blank_text(F.col("away_team")),
        "self_play": F.col("home_team") == F.col("away_team"),
        "negative_score": F.col("__neg"),
        "bad_score": ~F.col("__neg") & (F.col("home_score").isNull() | F.col("away_score").isNull()),
        "bad_neutral": F.col("neutral").isNull(),
    })).drop("__neg")


def completed_results(raw: DataFrame) -> DataFrame:
    """External results: only rows with both scores survive, then the same typing and labels."""
    present = raw.filter(~blank_text(F.col("home_score")) & ~blank_text(F.col("away_score")))
    return historical_results(present)


def fixture_schedule(raw: DataFrame, default_status: str = "scheduled", default_neutral: str = "true") -> DataFrame:
    """Fixture slate: defaults, date and a UTC kickoff text from whichever of the time columns exists."""
    date = F.trim("date")
    if "kickoff_at" in raw.columns:
        kickoff = F.trim("kickoff_at")
    elif "datetime" in raw.columns:
        kickoff = F.trim("datetime")
    elif "time" in raw.columns:
        kickoff = F.when(~blank_text(F.col("time")), F.concat_ws(" ", date, F.trim("time")))
    else:
        kickoff = F.when(date.rlike(r"[T ]\d{1,2}:\d{2}"), date)
    moment = F.try_to_timestamp(F.when(kickoff != "", kickoff))
    status = F.trim(F.col("status")) if "status" in raw.columns else F.lit(default_status)
    neutral = F.col("neutral") if "neutral" in raw.columns else F.lit(default_neutral)
    return raw.select(
        *[c for c in raw.columns if c in ("row_no", "match_id", "group")],
        F.try_to_timestamp(date).cast("date").alias("match_date"),
        F.coalesce(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("kickoff_at"),
        F.trim("home_team").alias("home_team"), F.trim("away_team").alias("away_team"),
        F.trim("tournament").alias("tournament"), parse_bool(neutral).alias("neutral"), status.alias("status"),
        compact_codes({
            "bad_date": F.try_to_timestamp(date).isNull(),
            "blank_team": blank_text(F.col("home_team")) | blank_text(F.col("away_team"))
                          | (F.lower(F.trim("home_team")) == "nan") | (F.lower(F.trim("away_team")) == "nan"),
            "bad_neutral": parse_bool(neutral).isNull(),
        }).alias("violations"),
    )


TEAM_CATALOG = "teams ARRAY<STRUCT<team_id STRING, name STRING, fifa_code STRING, confederation STRING>>, aliases MAP<STRING,STRING>"
COMPETITION_CATALOG = (
    "competitions ARRAY<STRUCT<competition_id STRING, name STRING, kind STRING, confederation STRING, "
    "senior_mens_a_international BOOLEAN>>, aliases MAP<STRING,STRING>"
)
METADATA = (
    "STRUCT<source STRING, ingested_at TIMESTAMP, available_at TIMESTAMP, source_record_id STRING, source_version STRING, "
    "event_time TIMESTAMP, leakage_risk STRING, legal_use_notes STRING>"
)
MEMBERSHIP = (
    "team_id STRING, periods ARRAY<STRUCT<confederation STRING, valid_from DATE, valid_to DATE>>, metadata " + METADATA
)


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Catalog documents, one JSON document per file, as parsed columns."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_catalog(docs: DataFrame, payload: str, schema: str) -> DataFrame:
    """The same from a text column that holds the documents."""
    return docs.select(F.from_json(payload, schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def catalog_entries(docs: DataFrame, entries: str) -> DataFrame:
    return docs.select(F.inline(entries))


def catalog_aliases(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("aliases").alias("label", "target_id"))


def membership_releases(docs: DataFrame, payload: str, teams: DataFrame) -> DataFrame:
    """Membership timelines of known teams; the release id is the content hash of the document."""
    parsed = docs.select(F.col(payload), F.from_json(payload, MEMBERSHIP).alias("d")).select(
        F.concat(F.lit("membership_release_"), F.sha2(payload, 256)).alias("release_id"), "d.*"
    )
    return parsed.join(teams.select("team_id"), "team_id", "left_semi")


def membership_periods(releases: DataFrame) -> DataFrame:
    return releases.select("team_id", "release_id", F.col("metadata.available_at").alias("available_at"), F.inline("periods"))


def observation_rejects(rows: DataFrame, now: str, require_settlement: bool) -> DataFrame:
    """Add violations to ranking or odds observations before they are stored."""
    moment = F.lit(now).cast("timestamp")
    rules = {
        "publication_time_missing": F.col("available_at").isNull(),
        "published_in_future": F.col("available_at") > moment,
        "legal_notes_missing": blank_text(F.col("legal_use_notes")),
    }
    if require_settlement:
        rules["settlement_basis"] = ~F.col("score_basis").eqNullSafe("regulation_time")
    return rows.withColumn("violations", compact_codes(rules))
