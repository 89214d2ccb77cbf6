"""Frequency and goal models expressed as aggregates (G1-G6, G16) and their fold backtests (H7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions.common import OUTCOMES
from .history import team_rows

# Fixed values of the goal model.
HOME_MULTIPLIER, MIN_GOALS, MAX_GOALS_RATE, GRID = 1.10, 0.20, 5.00, 10
SIDES = ("home", "draw", "away")


def class_frequency(train: DataFrame, by: list[str] = (), smoothing: float = 1.0) -> DataFrame:
    """Smoothed outcome shares, one row per ``by`` (one row in all when it is empty)."""
    counts = train.groupBy(*by).agg(F.count("*").alias("n"), *[
        F.count_if(F.col("target") == o).alias(f"c_{s}") for o, s in zip(OUTCOMES, SIDES)])
    return counts.select(*by, "n", *[((F.col(f"c_{s}") + smoothing) / (F.col("n") + 3 * smoothing)).alias(f"p_{s}") for s in SIDES])


def group_frequency(train: DataFrame, group: str, prior_strength: float = 10.0, smoothing: float = 1.0,
                    global_only: Column | None = None) -> DataFrame:
    """Group shares shrunk to the global ones; rows matching ``global_only`` count for the global shares alone."""
    base = class_frequency(train, (), smoothing)
    rows = train if global_only is None else train.filter(~global_only)
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), *[
        F.count_if(F.col("target") == o).alias(f"c_{s}") for o, s in zip(OUTCOMES, SIDES)])
    shrink = lambda s: (F.col(f"c_{s}") + prior_strength * base.select(f"p_{s}").scalar()) / (F.col("n") + prior_strength)
    return counts.select(group, "n", *[shrink(s).alias(f"p_{s}") for s in SIDES])


def score_groups(rows: DataFrame, fitted: DataFrame, base: DataFrame, group: str) -> DataFrame:
    """Group shares for each row, the global ones where its group was not seen."""
    known = fitted.select(group, *[F.col(f"p_{s}").alias(f"__{s}") for s in SIDES])
    out = rows.join(known, group, "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__{s}"), base.select(f"p_{s}").scalar()).alias(f"p_{s}") for s in SIDES])


def fit_poisson(train: DataFrame, by: list[str] = ()) -> DataFrame:
    """Attack and defence ratios of every team to the goal rate per team and match of its fold."""
    by = list(by)
    rows = team_rows(train.withColumn("kickoff_at", F.lit(None).cast("timestamp")).withColumn("match_date", F.lit(None).cast("date")), by)
    teams = rows.groupBy(*by, "team_id").agg(F.count("*").alias("matches"), F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"))
    if by:
        total = teams.groupBy(*by).agg((F.sum("gf") / F.sum("matches")).alias("global_rate"))
        teams = teams.join(total, by)
    else:
        teams = teams.withColumn("global_rate", teams.agg(F.sum("gf") / F.sum("matches")).scalar())
    return teams.select(*by, "team_id", "matches", "global_rate", (F.col("gf") / F.col("matches") / F.col("global_rate")).alias("attack"),
                        (F.col("ga") / F.col("matches") / F.col("global_rate")).alias("defence"))


def expected_goals(fixtures: DataFrame, teams: DataFrame, by: list[str] = (), unseen: str = "reject") -> DataFrame:
    """Goal rates of both sides. An unseen team gives the row a reason, or average strength with unseen='average'."""
    by = list(by)
    out = fixtures
    for side in ("home", "away"):
        part = teams.select(*by, F.col("team_id").alias(f"{side}_id"), F.col("attack").alias(f"__{side}_att"), F.col("defence").alias(f"__{side}_def"),
                            F.col("global_rate").alias(f"__{side}_rate"))
        out = out.join(part, [*by, f"{side}_id"], "left")
    rate = F.coalesce("__home_rate", "__away_rate") if by else teams.agg(F.max("global_rate")).scalar()
    missing = F.col("__home_att").isNull() | F.col("__away_att").isNull()
    value = lambda c: F.coalesce(F.col(c), F.lit(1.0)) if unseen == "average" else F.col(c)
    factor = F.when(F.col("neutral"), F.lit(1.0)).otherwise(F.lit(HOME_MULTIPLIER))

    def clip(x: Column) -> Column:
        return F.when(x.isNotNull(), F.greatest(F.lit(MIN_GOALS), F.least(F.lit(MAX_GOALS_RATE), x)))

    out = out.withColumn("__g", rate)
    home = F.col("__g") * value("__home_att") * value("__away_def") * factor
    away = F.col("__g") * value("__away_att") * value("__home_def") / factor
    reason = F.when(missing & F.lit(unseen == "reject"), F.lit("no_goal_history"))
    return out.withColumn("home_rate", clip(home)).withColumn("away_rate", clip(away)).withColumn("rejected", reason).select(
        *fixtures.columns, "home_rate", "away_rate", "rejected")


def _pmf(rate: Column, top: int) -> Column:
    """Poisson shares 0..top, each from the one before, so equal neighbours tie exactly."""
    first = F.array(F.exp(-rate))
    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), first, lambda done, k: F.concat(done, F.array(F.element_at(done, -1) * rate / k)))


def score_grid(fixtures: DataFrame, top: int = GRID) -> DataFrame:
    """Outcome shares, modal score, entropy and omitted tail of the independent score grid.

    The grid is a product of two short arrays inside each row: running totals give the shares in
    top + 1 steps, and the modal cell is the pair of modal goals. No row is multiplied, nothing shuffles.
    """
    rated = F.col("home_rate").isNotNull() & F.col("away_rate").isNotNull()
    out = fixtures.withColumns({"__h": F.when(rated, _pmf(F.col("home_rate"), top)), "__a": F.when(rated, _pmf(F.col("away_rate"), top))})
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("home", "draw", "away", "h", "a")])

    def step(acc: Column, pair: Column) -> Column:
        h, a = pair["h"], pair["a"]
        return F.struct((acc["home"] + h * acc["a"]).alias("home"), (acc["draw"] + h * a).alias("draw"), (acc["away"] + a * acc["h"]).alias("away"),
                        (acc["h"] + h).alias("h"), (acc["a"] + a).alias("a"))

    pairs = F.zip_with("__h", "__a", lambda h, a: F.struct(h.alias("h"), a.alias("a")))
    out = out.withColumn("__t", F.aggregate(pairs, zero, step)).withColumn("__kept", F.col("__t.h") * F.col("__t.a"))
    out = out.withColumns({f"p_{s}": F.col(f"__t.{s}") / F.col("__kept") for s in SIDES})
    place = lambda c: (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")
    return out.withColumns({
        "mode_home": place("__h"), "mode_away": place("__a"), "mode_probability": F.array_max("__h") * F.array_max("__a") / F.col("__kept"),
        "entropy": F.when(rated, P.entropy_nats(*P.triple())), "omitted_tail": F.when(rated, F.greatest(F.lit(0.0), 1.0 - F.col("__kept"))),
    }).drop("__h", "__a", "__t", "__kept")


def combine_members(rows: DataFrame, weight: float = 0.5, first: str = "p_", second: str = "q_") -> DataFrame:
    """Fixed two-member blend with its confidence, entropy and the members' largest disagreement."""
    a, b = P.renormalise(*P.triple(first)), P.renormalise(*P.triple(second))
    mixed = P.blend(a, b, weight)
    out = rows.withColumns({f"e_{s}": m for s, m in zip(SIDES, mixed)})
    e = P.triple("e_")
    return out.withColumns({
        "ensemble_confidence": P.confidence_label(*e), "ensemble_entropy": P.entropy_normalised(*e),
        "max_model_disagreement": P.max_disagreement(a, b), "ensemble_outcome": P.argmax_outcome(*e)})
