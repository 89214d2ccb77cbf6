"""Long feature rows, their contract, imputation and the datasets built from them (E16-E20, E27, A10 shape)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import outcome_label
from .asof import INTEGRITY, PRECISION, STALE, UPSTREAM

FEATURE_COLUMNS = ("match_id", "prediction_time", "feature", "value", "status", "reason", "imputation", "lineage")


def text_array(*items: Column) -> Column:
    """Sorted, distinct, non-null text items."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[i.cast("string") for i in items]))))


def no_lineage() -> Column:
    return F.array().cast("array<string>")


def feature(name: Column | str, value: Column, reason: Column | None = None, lineage: Column | None = None,
            imputation: Column | None = None) -> Column:
    """One entity-attribute-value struct; missing without value, imputed with a method, else observed."""
    value = value.cast("double")
    name = F.lit(name) if isinstance(name, str) else name
    imputation = F.lit(None).cast("string") if imputation is None else imputation
    reason = F.lit(None).cast("string") if reason is None else reason
    status = F.when(value.isNull(), F.lit("missing")).when(imputation.isNotNull(), F.lit("imputed")).otherwise(F.lit("observed"))
    kept_reason = F.when(value.isNull() | imputation.isNotNull(), reason)
    return F.struct(name.alias("feature"), value.alias("value"), status.alias("status"), kept_reason.alias("reason"),
                    imputation.alias("imputation"), (no_lineage() if lineage is None else F.coalesce(lineage, no_lineage())).alias("lineage"))


def explode_features(df: DataFrame, features: list[Column]) -> DataFrame:
    return df.select("match_id", "prediction_time", F.inline(F.array(*features)))


def combined_reason(*reasons: Column) -> Column:
    """Most safety-relevant reason: integrity, stale, precision, then whichever comes first."""
    present = F.array_compact(F.array(*reasons))
    ordered = F.when(F.array_contains(present, INTEGRITY), F.lit(INTEGRITY))
    for name in (STALE, PRECISION):
        ordered = ordered.when(F.array_contains(present, name), F.lit(name))
    return ordered.otherwise(F.coalesce(*reasons, F.lit(UPSTREAM)))


def difference(name: str, home: Column, away: Column, home_reason: Column, away_reason: Column,
               lineage: Column | None = None) -> Column:
    return feature(name, home - away, combined_reason(home_reason, away_reason), lineage)


def assemble(frames: list[DataFrame]) -> DataFrame:
    """All families of one run as one long frame."""
    result = frames[0].select(*FEATURE_COLUMNS)
    for frame in frames[1:]:
        result = result.unionByName(frame.select(*FEATURE_COLUMNS))
    return result


def contract_violations(features: DataFrame, contexts: DataFrame, declared: list[str]) -> DataFrame:
    """Matches whose computed features are not exactly the declared ones, once each, at the match's own cutoff.

    Sets per match are bounded by the number of declared features.
    """
    names = F.array(*[F.lit(d) for d in declared])
    known = F.col("feature").isin(*declared)
    joined = features.join(contexts.select("match_id", F.col("prediction_time").alias("__cut")), "match_id", "left")
    per_match = joined.groupBy("match_id").agg(
        F.count_if(~known).alias("undeclared"), F.count_if(known).alias("__n"),
        F.collect_set(F.when(known, F.col("feature"))).alias("__have"),
        F.count_if(~F.col("prediction_time").eqNullSafe(F.col("__cut"))).alias("wrong_cutoff"),
    )
    out = (
        per_match.withColumn("missing", F.size(F.array_except(names, "__have")).cast("long"))
        .withColumn("duplicated", F.col("__n") - F.size("__have"))
        .drop("__n", "__have")
    )
    return out.filter("undeclared > 0 OR missing > 0 OR duplicated > 0 OR wrong_cutoff > 0")


def impute(features: DataFrame, rules: dict[str, float]) -> DataFrame:
    """Fill missing values from constant rules; ``applied`` tells where, ``unruled`` where no rule exists."""
    keys = [F.lit(k) for k in rules]
    constant = F.lit(None).cast("double")
    if rules:
        table = F.map_from_arrays(F.array(*keys), F.array(*[F.lit(float(v)) for v in rules.values()]))
        constant = F.try_element_at(table, F.col("feature"))
    missing = F.col("value").isNull()
    return (
        features.withColumn("applied", missing & constant.isNotNull())
        .withColumn("unruled", missing & constant.isNull())
        .withColumn("filled", F.coalesce("value", constant))
    )


def materialize(features: DataFrame, declared: list[str], rules: dict[str, float], indicators: bool = True) -> DataFrame:
    """Long to wide: one row per match, features in name order with their status columns.

    The pivot list is the declaration, so no pass is spent on finding names. ``unruled_features``
    counts gaps that no rule covers; such rows must not reach a model.
    """
    filled = impute(features, rules)
    aggs: list[Column] = []
    for name in sorted(declared):
        mine = F.col("feature") == name
        aggs.append(F.max(F.when(mine, F.col("filled"))).alias(name))
        if indicators:
            aggs.append(F.max(F.when(mine, (F.col("status") == "missing").cast("double"))).alias(f"{name}__is_missing"))
            touched = (F.col("status") == "imputed") | F.col("applied")
            aggs.append(F.max(F.when(mine, touched.cast("double"))).alias(f"{name}__is_imputed"))
    return filled.groupBy("match_id", "prediction_time").agg(
        *aggs, F.count_if("applied").alias("applied_imputations"), F.count_if("unruled").alias("unruled_features"))


def historical_dataset(matches: DataFrame, wide: DataFrame) -> DataFrame:
    """Completed rows with features at their own cutoff, the target and when the target became known."""
    target = matches.filter(F.col("eligible_at").isNotNull()).select(
        "match_id", outcome_label("home_score", "away_score").alias("target"), F.col("eligible_at").alias("target_available_at"),
        F.col("eligibility_basis").alias("target_basis"))
    return wide.join(target, "match_id")


def model_dataset(examples: DataFrame, declared: list[str]) -> DataFrame:
    """Examples fit for a model: every declared column present and finite, ordered when written."""
    missing = sorted(set(declared) - set(examples.columns))
    if missing:
        raise ValueError(f"Examples lack declared features: {missing}")
    usable = F.lit(True)
    for name in declared:
        usable = usable & F.col(f"`{name}`").isNotNull() & ~F.isnan(F.col(f"`{name}`"))
    return examples.filter(usable)


# Neutral defaults of the pre-match feature table.
def default_value(column: str) -> float:
    return 1.0 if column.endswith(("_points_per_match", "_goals_for_per_match", "_goals_against_per_match")) else 0.0


def neutralise(features: DataFrame, all_columns: list[str], active: list[str]) -> DataFrame:
    """Hold inactive feature columns at their neutral default."""
    return features.withColumns({c: F.lit(default_value(c)) for c in all_columns if c not in active})


def with_defaults(features: DataFrame, columns: list[str]) -> DataFrame:
    """Every declared column present, numeric and without gaps."""
    return features.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(default_value(c))) if c in features.columns else F.lit(default_value(c))
        for c in columns
    })
