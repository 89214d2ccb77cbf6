"""Three-way outcome and probability expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import OUTCOMES, col


def outcome_label(home: Column | str, away: Column | str) -> Column:
    home, away = col(home), col(away)
    return (
        F.when(home > away, F.lit("home_win"))
        .when(home < away, F.lit("away_win"))
        .when(home == away, F.lit("draw"))
    )


def triple(prefix: str = "p_") -> tuple[Column, Column, Column]:
    """The three probability columns of a frame, home, draw, away."""
    return F.col(prefix + "home"), F.col(prefix + "draw"), F.col(prefix + "away")


def argmax_outcome(home: Column, draw: Column, away: Column) -> Column:
    """Most likely outcome; ties go to home, then draw, then away."""
    return (
        F.when((home >= draw) & (home >= away), F.lit("home_win"))
        .when(draw >= away, F.lit("draw"))
        .otherwise(F.lit("away_win"))
    )


def pick(outcome: Column | str, home: Column, draw: Column, away: Column) -> Column:
    """The value belonging to an outcome label."""
    outcome = col(outcome)
    return (
        F.when(outcome == "home_win", home).when(outcome == "draw", draw).when(outcome == "away_win", away)
    )


def is_distribution(home: Column, draw: Column, away: Column, tolerance: float = 1e-9) -> Column:
    inside = [(p >= 0) & (p <= 1) for p in (home, draw, away)]
    return inside[0] & inside[1] & inside[2] & (F.abs(home + draw + away - 1) <= tolerance)


def winner_name(outcome: Column | str, home_team: Column, away_team: Column) -> Column:
    return F.coalesce(
        F.when(col(outcome) == "home_win", home_team).when(col(outcome) == "away_win", away_team), F.lit("Draw")
    )


def devig(home_odds: Column, draw_odds: Column, away_odds: Column) -> Column:
    """Struct(home, draw, away, overround, implied_total) of fair probabilities."""
    raw = [1.0 / home_odds, 1.0 / draw_odds, 1.0 / away_odds]
    total = raw[0] + raw[1] + raw[2]
    return F.struct(
        (raw[0] / total).alias("home"), (raw[1] / total).alias("draw"), (raw[2] / total).alias("away"),
        (total - 1.0).alias("overround"), total.alias("implied_total"),
    )


def implied_probability(odds: Column | str) -> Column:
    return F.when(col(odds) > 1.0, 1.0 / col(odds))


def expected_value(probability: Column, odds: Column) -> Column:
    return probability * odds - 1.0


def kelly_fraction(probability: Column, odds: Column) -> Column:
    net = odds - 1.0
    return (net * probability - (1.0 - probability)) / net


def entropy_nats(home: Column, draw: Column, away: Column) -> Column:
    parts = [F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in (home, draw, away)]
    return -(parts[0] + parts[1] + parts[2])


def entropy_normalised(home: Column, draw: Column, away: Column) -> Column:
    return entropy_nats(home, draw, away) / math.log(3)


def renormalise(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    total = home + draw + away
    return home / total, draw / total, away / total


def max_disagreement(first: tuple[Column, ...], second: tuple[Column, ...]) -> Column:
    return F.greatest(*[F.abs(a - b) for a, b in zip(first, second)])


def confidence_label(home: Column, draw: Column, away: Column) -> Column:
    top = F.greatest(home, draw, away)
    return (
        F.when((top >= 0.60) & (entropy_normalised(home, draw, away) <= 0.75), F.lit("High"))
        .when(top >= 0.45, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def blend(first: tuple[Column, ...], second: tuple[Column, ...], weight: float = 0.5):
    """Weighted average of two distributions, renormalised."""
    mixed = [weight * a + (1.0 - weight) * b for a, b in zip(first, second)]
    return renormalise(*mixed)


def poisson_pmf(k: Column, rate: Column) -> Column:
    """P(K = k); evaluated in logs so no factorial overflows."""
    log_factorial = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double"))
    )
    return F.exp(k * F.ln(rate) - rate - log_factorial)


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life_days)


def realised_return(best: Column | str, final: Column | str, home_odds: Column, draw_odds: Column,
                    away_odds: Column, stake: Column) -> Column:
    best, final = col(best), col(final)
    gain = stake * (pick(best, home_odds, draw_odds, away_odds) - 1.0)
    valid = best.isin(*OUTCOMES) & final.isin(*OUTCOMES) & (stake > 0)
    return F.when(valid, F.when(best == final, gain).otherwise(-stake))


def closing_line_value(market: Column, closing: Column) -> Column:
    """Relative move from the taken price to the close; null where either price is unusable."""
    return F.when((market > 1.0) & (closing > 1.0), market / closing - 1.0)


def market_direction(outcome: Column, move: Column) -> Column:
    return (
        F.when(move > 0, F.concat(F.lit("market_toward_"), outcome))
        .when(move < 0, F.concat(F.lit("market_away_from_"), outcome))
        .otherwise(F.lit("market_unchanged"))
    )


def rank_bucket(rank: Column) -> Column:
    """Ordinal bucket: up to 10, 25, 50, 100, beyond."""
    return sum(((rank > bound).cast("int") for bound in (10, 25, 50, 100)), F.lit(1))


def log_loss(actual: Column | str, home: Column, draw: Column, away: Column) -> Column:
    realised = pick(actual, home, draw, away)
    return F.when(realised.isNotNull(), -F.ln(F.least(F.lit(1.0), F.greatest(F.lit(1e-15), realised))))


def _hits(actual: Column | str) -> list[Column]:
    return [(col(actual) == o).cast("double") for o in OUTCOMES]


def brier(actual: Column | str, home: Column, draw: Column, away: Column) -> Column:
    h, d, a = _hits(actual)
    return (home - h) * (home - h) + (draw - d) * (draw - d) + (away - a) * (away - a)


def ranked_probability_score(actual: Column | str, home: Column, draw: Column, away: Column) -> Column:
    h, d, _ = _hits(actual)
    first, second = home - h, (home + draw) - (h + d)
    return (first * first + second * second) / 2.0


def metric_row(actual: Column | str, home: Column, draw: Column, away: Column) -> dict[str, Column]:
    """Per-row metrics by name; averaging them over any grouping gives the aggregate metrics."""
    return {
        "accuracy": (argmax_outcome(home, draw, away) == col(actual)).cast("double"),
        "log_loss": log_loss(actual, home, draw, away),
        "brier": brier(actual, home, draw, away),
        "rps": ranked_probability_score(actual, home, draw, away),
    }
