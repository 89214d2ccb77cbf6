"""Append-only tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared columns of the append-only tables.
SCHEMAS = {
    "market_snapshots": "fixture_id STRING, snapshot_timestamp TIMESTAMP, home_team STRING, away_team STRING, "
                        "market_home_odds DOUBLE, market_draw_odds DOUBLE, market_away_odds DOUBLE, source STRING",
    "player_availability": "team STRING, player_name STRING, position STRING, status STRING, importance_rating DOUBLE, "
                           "expected_minutes DOUBLE, source STRING",
    "injury_suspension_events": "team STRING, player_name STRING, event_type STRING, status STRING, event_date DATE, "
                                "source STRING",
    "model_registry": "model_id STRING, model_type STRING, feature_set_id STRING, trained_at TIMESTAMP, metrics STRING",
    "scheduled_runs": "run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, row_count BIGINT, "
                      "message STRING",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast to a declared schema; a missing column is an error before anything is written."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMAS[table])
    missing = sorted(set(schema.names) - set(df.columns))
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def append(df: DataFrame, path: str, table: str | None = None, partition_by: list[str] = ()) -> None:
    (conform(df, table) if table else df).write.mode("append").partitionBy(*partition_by).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result table as Parquet, CSV or JSON lines, one file per task."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else getattr(writer, fmt)(path)


def to_feature_store(features: DataFrame, entity_columns: list[str], feature_columns: list[str], feature_set_id: str,
                     entity_type: str, feature_date: Column) -> DataFrame:
    """Wide features as long rows; missing values are not stored."""
    keyed = features.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in entity_columns]).alias("entity_id"),
        feature_date.alias("feature_date"), *[F.col(c).cast("double") for c in feature_columns],
    )
    long = keyed.unpivot(["entity_id", "feature_date"], feature_columns, "feature_name", "feature_value")
    return long.filter(F.col("feature_value").isNotNull()).select(
        F.lit(feature_set_id).alias("feature_set_id"), F.lit(entity_type).alias("entity_type"), "entity_id",
        "feature_date", "feature_name", "feature_value",
    )


def to_prediction_ledger(forecasts: DataFrame, model_id: str) -> DataFrame:
    """Forecast rows as open ledger entries keyed by date, home and away."""
    fixture = F.concat_ws(":", F.col("match_date").cast("string"), "home_team", "away_team")
    return forecasts.select(
        fixture.alias("fixture_id"), F.lit(model_id).alias("model_id"), "match_date", "home_team", "away_team",
        "predicted_outcome", "model_confidence", "prob_home_win", "prob_draw", "prob_away_win", F.lit("open").alias("status"),
    )


def newest_first(spark: SparkSession, path: str, time_column: str, id_column: str) -> DataFrame:
    """Audit or registry table, newest entry first."""
    return spark.read.parquet(path).orderBy(F.col(time_column).desc(), F.col(id_column).desc())
