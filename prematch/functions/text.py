"""Parsing and normalising source text (inventory B1-B6, B9, B19, B22, B26)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import col

# Accepted spellings, enums and weights of the data contract.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
MATCH_STATUSES = ("scheduled", "completed", "postponed", "cancelled")
SCORE_BASES = ("unknown", "regulation_time", "after_extra_time", "including_shootout", "shootout_only")
AVAILABILITY_WEIGHTS = {
    "available": 1.0, "fit": 1.0, "probable": 0.85, "questionable": 0.50, "doubtful": 0.25,
    "limited": 0.65, "out": 0.0, "injured": 0.0, "suspended": 0.0, "unavailable": 0.0,
}
UNKNOWN_AVAILABILITY_WEIGHT = 0.50


def _blank_to_null(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def parse_bool(value: Column | str) -> Column:
    """Closed-vocabulary boolean; anything else is null and left to the rejects rule."""
    text = F.lower(F.trim(col(value).cast("string")))
    return F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(text.isin(*FALSE_WORDS), F.lit(False))


def parse_score(value: Column | str) -> Column:
    """Whole, non-negative goals from text; blank or invalid text becomes null."""
    number = _blank_to_null(col(value)).try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.try_cast("int"))


def score_is_invalid(value: Column | str) -> Column:
    return _blank_to_null(col(value)).isNotNull() & parse_score(value).isNull()


def has_zone(value: Column | str) -> Column:
    return F.trim(col(value)).rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & F.trim(col(value)).rlike(r"\d[T ]\d")


def parse_utc(value: Column | str) -> Column:
    """Timestamp from text that carries an offset; text without one is null (see has_zone)."""
    text = _blank_to_null(col(value))
    return F.when(has_zone(text), text.try_cast("timestamp"))


def map_status(value: Column | str, mapping: dict[str, str] | None = None,
               default: str = "scheduled") -> Column:
    """Source status through an optional mapping, then the closed enum; blank takes the default."""
    text = F.lower(_blank_to_null(col(value)))
    result = F.when(text.isNull(), F.lit(default))
    for source, target in (mapping or {}).items():
        result = result.when(text == source.lower(), F.lit(target))
    return result.when(text.isin(*MATCH_STATUSES), text)


def resolve_score_basis(row_basis: Column | str, asserted: str = "unknown") -> Column:
    """Struct(basis, conflict): a mapped row is authoritative, blanks stay unknown."""
    text = F.coalesce(_blank_to_null(col(row_basis)), F.lit("unknown"))
    basis = F.when(text.isin(*SCORE_BASES), text)
    conflict = (F.lit(asserted != "unknown") & ~basis.eqNullSafe(asserted)) | basis.isNull()
    return F.struct(basis.alias("basis"), conflict.alias("conflict"),
                    basis.eqNullSafe("regulation_time").alias("usable"))


def normalize_name(value: Column | str) -> Column:
    """Case-folded, space-collapsed name for ASCII text (see normalize_names for the rest)."""
    return F.trim(F.regexp_replace(F.lower(col(value)), r"[\s\x1c-\x1f]+", " "))


@F.pandas_udf(StringType())
def _unicode_fold(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    )


def normalize_names(df: DataFrame, column: str, out: str) -> DataFrame:
    """Full Unicode normalisation: ASCII stays in the JVM, other names go through Arrow once each."""
    is_ascii = F.length(F.col(column)) == F.octet_length(F.col(column))
    special = (
        df.filter(~is_ascii).select(column).distinct().withColumn("__folded", _unicode_fold(F.col(column)))
    )
    return (
        df.join(special, column, "left")
        .select(*[F.col(c) for c in df.columns], F.coalesce("__folded", normalize_name(column)).alias(out))
    )


def scope_decision(gender: Column | str, level: Column | str, official: Column | str) -> Column:
    """Struct(decision, reason); the first matching rule wins."""
    gender, level, official = col(gender), col(level), col(official)

    def outcome(decision: str, reason: Column) -> Column:
        return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))

    return (
        F.when(gender == "unknown", outcome("review", F.lit("gender_unknown")))
        .when(level == "unknown", outcome("review", F.lit("team_level_unknown")))
        .when(official.isNull(), outcome("review", F.lit("official_status_unknown")))
        .when(gender != "men", outcome("exclude", F.concat(F.lit("gender_out_of_scope:"), gender)))
        .when(level != "senior_a", outcome("exclude", F.concat(F.lit("team_level_out_of_scope:"), level)))
        .when(~official, outcome("exclude", F.lit("unofficial_match")))
        .otherwise(outcome("include", F.lit("senior_mens_a_international")))
    )


def availability_weight(status: Column | str) -> Column:
    """Numeric availability of a status text; unknown text counts one half."""
    text = F.regexp_replace(F.lower(F.trim(col(status))), " ", "_")
    result = F.lit(UNKNOWN_AVAILABILITY_WEIGHT)
    by_weight: dict[float, list[str]] = {}
    for word, weight in AVAILABILITY_WEIGHTS.items():
        by_weight.setdefault(weight, []).append(word)
    chain = None
    for weight, words in by_weight.items():
        cond = text.isin(*words)
        chain = F.when(cond, F.lit(weight)) if chain is None else chain.when(cond, F.lit(weight))
    return chain.otherwise(result)


def fixture_tournament_weight(name: Column | str) -> Column:
    """The serving-side tournament scale (distinct from the rating importance scale)."""
    text = F.lower(col(name))
    return (
        F.when(text.contains("world cup") & ~text.contains("qualification"), F.lit(1.0))
        .when(text.contains("qualification"), F.lit(0.75))
        .when(text.contains("nations league"), F.lit(0.65))
        .when(text.contains("friendly"), F.lit(0.35))
        .otherwise(F.lit(0.50))
    )


def encode_payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def decode_payload(payload: Column | str, schema: str) -> Column:
    return F.from_json(col(payload), schema)
