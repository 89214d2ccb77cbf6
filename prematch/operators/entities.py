"""Entity resolution, disposition of source rows and duplicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_match_id
from ..functions.text import normalize_names, scope_decision


def resolve(df: DataFrame, name: str, canonical: DataFrame, aliases: DataFrame, out: str) -> DataFrame:
    """Attach ``out`` (id) and ``out``_matched_by; the canonical name wins over an alias.

    canonical has (name, entity_id), aliases has (label, entity_id). Names compare normalised. Spark
    broadcasts the catalogs when they are small and shuffles them when they are not.
    """
    key = f"__{out}_key"
    direct = normalize_names(canonical, "name", key).select(key, F.col("entity_id").alias("__direct"))
    alias = normalize_names(aliases, "label", key).select(key, F.col("entity_id").alias("__alias"))
    joined = normalize_names(df, name, key).join(direct, key, "left").join(alias, key, "left")
    method = F.when(F.col("__direct").isNotNull(), F.lit("canonical_name")).when(
        F.col("__alias").isNotNull(), F.lit("alias"))
    kept = [F.col(c) for c in df.columns if c not in (out, f"{out}_matched_by")]
    return joined.select(*kept, F.coalesce("__direct", "__alias").alias(out), method.alias(f"{out}_matched_by"))


def route(df: DataFrame, in_scope: str | Column) -> DataFrame:
    """Decide normalized, excluded or quarantined with reasons.

    Expects gender, team_level, official, the resolved home_id, away_id and competition_id and the
    source names; in_scope tells whether the resolved competition belongs to the product.
    """
    scoped = df.withColumn("__scope", scope_decision("gender", "team_level", "official"))
    unresolved = F.array_compact(F.array(*[
        F.when(F.col(i).isNull(), F.concat(F.lit(f"unresolved_{label}:"), F.trim(n)))
        for i, label, n in (("home_id", "home_team", "home_team"), ("away_id", "away_team", "away_team"),
                            ("competition_id", "competition", "tournament"))
    ]))
    in_scope = F.col(in_scope) if isinstance(in_scope, str) else in_scope
    decision = F.col("__scope.decision")
    scope_reason = F.array(F.col("__scope.reason"))
    out_of_scope = ~F.coalesce(in_scope, F.lit(False))

    def result(name: str, reasons: Column) -> Column:
        return F.struct(F.lit(name).alias("decision"), reasons.alias("reasons"))

    disposition = (
        F.when(decision == "exclude", result("excluded", scope_reason))
        .when(decision == "review", result("quarantined", scope_reason))
        .when(F.size(unresolved) > 0, result("quarantined", unresolved))
        .when(out_of_scope, result("excluded", F.array(F.lit("competition_out_of_scope"))))
        .otherwise(result("normalized", F.array(F.lit("canonicalized"))))
    )
    return scoped.withColumn("__d", disposition).select(*df.columns, "__d.decision", "__d.reasons").withColumn(
        "match_id", F.when(F.col("decision") == "normalized", canonical_match_id("match_date", "home_id", "away_id", "competition_id"))
    )


def pair_key(date: str = "match_date", home: str = "home_id", away: str = "away_id",
             competition: str = "competition_id") -> list[Column]:
    """Identity of a fixture that ignores which side is at home."""
    return [F.col(date).alias("__date"), F.least(home, away).alias("__low"), F.greatest(home, away).alias("__high"),
            F.col(competition).alias("__comp")]


def quarantine_duplicates(routed: DataFrame, order: str, source_id: str) -> DataFrame:
    """Later copies of a fixture, reversed or not, become quarantined and name the row that came first.

    The first row per fixture is a min_by aggregate (combined map-side), so a fixture repeated in a
    large share of the input never gathers in one task.
    """
    keys = ["__date", "__low", "__high", "__comp"]
    keyed = routed.select("*", *pair_key())
    accepted = keyed.filter(F.col("decision") == "normalized")
    first = accepted.groupBy(*keys).agg(F.min(order).alias("__first"), F.min_by(source_id, order).alias("__first_id"))
    normal = F.col("decision") == "normalized"
    joined = accepted.join(first, keys, "left")
    later = normal & F.coalesce(F.col(order) > F.col("__first"), F.lit(False))  # a row without a date has no group and is nobody's copy
    marked = joined.withColumn("reasons", F.when(
        later, F.array(F.concat(F.lit("duplicate_or_reversed_fixture:"), F.col("__first_id").cast("string")))).otherwise(F.col("reasons")))
    marked = marked.withColumn("match_id", F.when(~later, F.col("match_id")))
    marked = marked.withColumn("decision", F.when(later, F.lit("quarantined")).otherwise(F.col("decision")))
    return marked.select(*routed.columns).unionByName(routed.filter(F.col("decision") != "normalized"))


def split_dispositions(routed: DataFrame) -> dict[str, DataFrame]:
    """The three output tables with fixed columns."""
    reasons = F.concat_ws("|", "reasons").alias("reasons")
    return {
        "normalized": routed.filter("decision = 'normalized'").select(
            "match_id", "match_date", "home_id", "away_id", "competition_id", "row_no"),
        "excluded": routed.filter("decision = 'excluded'").select("row_no", reasons),
        "quarantined": routed.filter("decision = 'quarantined'").select("row_no", reasons),
    }


def reversed_against_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """New matches whose fixture is stored under another match id.

    Stored ids are reduced to their extremes per fixture before the join, so copies do not multiply.
    """
    keys = ["__date", "__low", "__high", "__comp"]
    known = stored.select("match_id", *pair_key()).groupBy(*keys).agg(
        F.min("match_id").alias("__min"), F.max("match_id").alias("__max"))
    joined = incoming.select("*", *pair_key()).join(known, keys)
    conflict = F.when(F.col("__max") != F.col("match_id"), F.col("__max")).when(
        F.col("__min") != F.col("match_id"), F.col("__min"))
    return joined.withColumn("stored_match_id", conflict).filter(F.col("stored_match_id").isNotNull()).drop(
        *keys, "__min", "__max")


def lookup_ratings(fixtures: DataFrame, ratings: DataFrame, aliases: DataFrame, default: float = 1500.0) -> DataFrame:
    """Ratings of both sides with their provenance and a warning that names sides on the default.

    ratings has (team, rating); aliases has (label, team).
    """
    out = fixtures
    for side in ("home", "away"):
        name = F.trim(F.col(f"{side}_team"))
        a = aliases.select(F.col("label").alias("__label"), F.col("team").alias("__target"))
        r = ratings.select(F.col("team").alias("__team"), F.col("rating").alias("__rating"))
        out = out.join(a, name == F.col("__label"), "left").withColumn("__lookup", F.coalesce(F.col("__target"), name))
        out = out.join(r, F.col("__lookup") == F.col("__team"), "left")
        source = F.when(F.col("__rating").isNull(), F.lit("fallback_1500")).when(
            F.col("__lookup") != name, F.lit("alias_lookup")).otherwise(F.lit("rating_lookup"))
        out = (
            out.withColumn(f"{side}_rating_source", source)
            .withColumn(f"{side}_rating", F.coalesce(F.col("__rating"), F.lit(default)))
            .drop("__label", "__target", "__lookup", "__team", "__rating")
        )
    missing = F.concat_ws(",", *[F.when(F.col(f"{s}_rating_source") == "fallback_1500", F.col(f"{s}_team")) for s in ("home", "away")])
    return out.withColumn("rating_warning", F.when(missing != "", F.concat(F.lit("fallback_rating_used:"), missing)).otherwise(F.lit("")))
