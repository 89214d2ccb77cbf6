"""Rating, distance and period expressions (B12, B18, inflation of F4)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

# Fixed values of the rating models.
ELO_START = 1500.0
ELO_K = 20.0
ELO_HOME_ADVANTAGE = 75.0
GLICKO_START = (1500.0, 350.0)
GLICKO_MAX_DEVIATION = 350.0
GLICKO_MONTHLY_DRIFT = 50.0
GLICKO_Q = math.log(10) / 400
CONTINENTAL_TOKENS = ("euro", "copa america", "african cup", "asian cup", "gold cup", "nations league")
EARTH_RADIUS_KM = 6371.0088


def expected_score(own: Column, other: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))


def actual_score(goals_for: Column, goals_against: Column) -> Column:
    return (
        F.when(goals_for > goals_against, F.lit(1.0)).when(goals_for == goals_against, F.lit(0.5)).otherwise(F.lit(0.0))
    )


def importance(tournament: Column | str) -> Column:
    name = F.lower(F.trim(col(tournament)))
    continental = name.contains(CONTINENTAL_TOKENS[0])
    for token in CONTINENTAL_TOKENS[1:]:
        continental = continental | name.contains(token)
    return (
        F.when(name == "fifa world cup", F.lit(1.60))
        .when(name.contains("world cup") & name.contains("qualification"), F.lit(1.25))
        .when(continental, F.lit(1.15))
        .when(name.contains("friendly"), F.lit(0.75))
        .otherwise(F.lit(1.00))
    )


def margin_multiplier(goals_for: Column, goals_against: Column, rating_difference: Column) -> Column:
    gap = F.abs(goals_for - goals_against)
    scaled = F.ln(gap + 1.0) * (2.2 / (0.001 * F.abs(rating_difference) + 2.2))
    return F.when(gap <= 1, F.lit(1.0)).otherwise(scaled)


def home_advantage(neutral: Column | str, points: float = ELO_HOME_ADVANTAGE) -> Column:
    return F.when(col(neutral), F.lit(0.0)).otherwise(F.lit(points))


def elo_change(home_rating: Column, away_rating: Column, home_goals: Column, away_goals: Column,
               neutral: Column | str, weight: Column, k: float = ELO_K,
               advantage: float = ELO_HOME_ADVANTAGE) -> Column:
    """Points moved from the away side to the home side by one result."""
    adjusted = home_rating + home_advantage(neutral, advantage)
    multiplier = margin_multiplier(home_goals, away_goals, adjusted - away_rating)
    return k * weight * multiplier * (actual_score(home_goals, away_goals) - expected_score(adjusted, away_rating))


def inflate_deviation(deviation: Column, days: Column) -> Column:
    grown = F.sqrt(deviation * deviation + GLICKO_MONTHLY_DRIFT**2 * days / 30.0)
    return F.when(grown.isNotNull(), F.least(F.lit(GLICKO_MAX_DEVIATION), grown))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (b - a) / 2.0, F.radians(lon2 - lon1) / 2.0
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(a) * F.cos(b) * F.sin(half_lon) * F.sin(half_lon)
    # least() skips nulls, so an unknown place must be kept out of it
    return F.when(h.isNotNull(), EARTH_RADIUS_KM * 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))
