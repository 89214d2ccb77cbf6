"""Chronological backtests of the aggregate models, all folds in one query (H7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import outcome_label
from . import baselines as B
from .evaluation import assign_folds


def _roles(examples: DataFrame, folds: list[dict]) -> tuple[DataFrame, DataFrame]:
    tagged = assign_folds(examples, folds).withColumn("target", outcome_label("home_score", "away_score"))
    test = tagged.filter("role = 'test'").withColumn("actual", F.col("target"))
    return tagged.filter("role = 'train'"), test


def frequency_backtest(examples: DataFrame, folds: list[dict]) -> DataFrame:
    train, test = _roles(examples, folds)
    fitted = B.class_frequency(train, ["fold_id"]).drop("n")
    return test.join(fitted, "fold_id").withColumn("model_family", F.lit("class_frequency"))


def poisson_backtest(examples: DataFrame, folds: list[dict]) -> DataFrame:
    """Score model fitted per fold; test matches with a team unseen in the fold's training rows are left out."""
    train, test = _roles(examples, folds)
    teams = B.fit_poisson(train, ["fold_id"])
    rated = B.expected_goals(test, teams, ["fold_id"]).filter(F.col("rejected").isNull())
    return B.score_grid(rated).withColumn("model_family", F.lit("independent_poisson"))
