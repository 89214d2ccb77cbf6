"""Market decisions, stakes, ledger settlement and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import probability as P
from ..functions.common import OUTCOMES, compact_codes

# Decision thresholds, policy gates and stake limits.
MIN_EDGE, MIN_EXPECTED_VALUE = 0.03, 0.02
POLICY = {"edge": 0.05, "expected_value": 0.05, "entropy": 1.0, "disagreement": 0.50, "implied_total": 1.08,
          "confidences": ("High", "Medium")}
STAKES = {"fraction": 0.25, "single_cap": 0.02, "portfolio_cap": 0.05, "bankroll": 1000.0}
ODDS = ("home_odds", "draw_odds", "away_odds")


def _odds() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ODDS)


def market_edges(slate: DataFrame, prefix: str = "p_", min_edge: float = MIN_EDGE,
                 min_expected_value: float = MIN_EXPECTED_VALUE) -> DataFrame:
    """Model against market for every row: fair prices, edges, expected values, best outcome, decision."""
    probs = P.triple(prefix)
    fair = P.devig(*_odds())
    out = slate.withColumn("__f", fair)
    for name, prob, odds, side in zip(OUTCOMES, probs, ODDS, ("home", "draw", "away")):
        out = (
            out.withColumn(f"market_fair_{name}", F.col("__f")[side])
            .withColumn(f"edge_{name}", prob - F.col(f"market_fair_{name}"))
            .withColumn(f"expected_value_{name}", P.expected_value(prob, F.col(odds)))
        )
    values = [F.col(f"expected_value_{n}") for n in OUTCOMES]
    out = (
        out.withColumn("overround", F.col("__f.overround")).withColumn("implied_total", F.col("__f.implied_total"))
        .withColumn("best_outcome", P.argmax_outcome(*values))
        .withColumn("best_edge", P.pick("best_outcome", *[F.col(f"edge_{n}") for n in OUTCOMES]))
        .withColumn("best_expected_value", P.pick("best_outcome", *values))
        .drop("__f")
    )
    candidate = (F.col("best_edge") >= min_edge) & (F.col("best_expected_value") >= min_expected_value)
    return out.withColumn("decision", F.when(candidate, F.lit("candidate_edge")).otherwise(F.lit("no_edge")))


def evaluate_slate(forecasts: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
    """Join forecasts made once to every quoted price and value them; columns p_* and q_* are the two members."""
    joined = odds.join(forecasts, keys, "inner")
    ensemble = P.triple()
    return (
        market_edges(joined)
        .withColumn("ensemble_confidence", P.confidence_label(*ensemble))
        .withColumn("ensemble_entropy", P.entropy_normalised(*ensemble))
    )


def ranked(edges: DataFrame) -> DataFrame:
    """Candidates first, then by expected value and edge."""
    return edges.orderBy(F.col("decision") != "candidate_edge", F.col("best_expected_value").desc(), F.col("best_edge").desc())


def apply_policy(edges: DataFrame, policy: dict = POLICY) -> DataFrame:
    reasons = compact_codes({
        "decision_not_candidate_edge": F.col("decision") != "candidate_edge",
        "edge_below_threshold": F.col("best_edge") < policy["edge"],
        "expected_value_below_threshold": F.col("best_expected_value") < policy["expected_value"],
        "entropy_above_limit": F.col("ensemble_entropy") > policy["entropy"],
        "model_disagreement_above_limit": F.col("max_model_disagreement") > policy["disagreement"],
        "market_overround_above_limit": F.col("implied_total") > policy["implied_total"],
        "confidence_not_allowed": ~F.col("ensemble_confidence").isin(*policy["confidences"]),
    })
    checked = edges.withColumn("__r", reasons)
    passed = F.size("__r") == 0
    return (
        checked.withColumn("strategy_action", F.when(passed, F.lit("actionable")).otherwise(F.lit("filtered")))
        .withColumn("strategy_reason", F.when(passed, F.lit("passes_policy")).otherwise(F.array_join("__r", ";")))
        .drop("__r")
    )


def size_stakes(edges: DataFrame, portfolio: list[str], policy: dict = STAKES, prefix: str = "p_") -> DataFrame:
    """Fractional Kelly with a cap per row and proportional scaling where a portfolio exceeds its cap.

    Portfolio totals are a grouped aggregate joined back, so one portfolio may hold every row.
    """
    actionable = F.col("strategy_action") == "actionable"
    kelly = P.kelly_fraction(P.pick("best_outcome", *P.triple(prefix)), P.pick("best_outcome", *_odds()))
    sized = edges.withColumn("full_kelly_fraction", F.when(actionable, kelly).otherwise(0.0))
    positive = actionable & (F.col("full_kelly_fraction") > 0)
    fractional = F.col("full_kelly_fraction") * policy["fraction"]
    sized = sized.withColumn("__s", F.when(positive, F.least(fractional, F.lit(policy["single_cap"]))).otherwise(0.0))
    reason = (
        F.when(~actionable, F.lit("not_actionable")).when(~positive, F.lit("non_positive_kelly"))
        .when(F.col("__s") < fractional, F.lit("single_bet_cap_applied")).otherwise(F.lit("fractional_kelly"))
    )
    totals = sized.groupBy(*portfolio).agg(F.sum("__s").alias("__total"))
    sized = sized.join(totals, portfolio, "left")
    over = F.col("__total") > policy["portfolio_cap"]
    stake = F.when(over, F.col("__s") * policy["portfolio_cap"] / F.col("__total")).otherwise(F.col("__s"))
    return (
        sized.withColumn("suggested_stake_fraction", stake)
        .withColumn("suggested_stake_amount", stake * policy["bankroll"])
        .withColumn("stake_sizing_reason",
                    F.when(over & (F.col("__s") > 0), F.concat(reason, F.lit(";portfolio_cap_scaled"))).otherwise(reason))
        .drop("__s", "__total")
    )


LEDGER_OPEN_COLUMNS = ("final_home_score", "final_away_score", "final_outcome", "realized_return",
                       "closing_home_odds", "closing_draw_odds", "closing_away_odds")


def to_ledger(sized: DataFrame, only_actionable: bool = True) -> DataFrame:
    """Open ledger rows for the actionable candidates; result columns start empty."""
    keep = sized.filter(F.col("strategy_action") == "actionable") if only_actionable else sized
    out = keep
    for name in LEDGER_OPEN_COLUMNS:
        kind = "string" if name == "final_outcome" else "int" if "score" in name else "double"
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def settle(ledger: DataFrame, results: DataFrame, order: str, flat_stake: float = 1.0) -> DataFrame:
    """Settle open ledger rows; the first fitting result in input order wins.

    A result fits when the teams agree and, if the result names a kickoff, the ledger kickoff is the
    same or unknown. Results are first reduced to the earliest per (teams, kickoff), per (teams, no
    kickoff) and per teams, so each ledger row meets at most three candidates.
    """
    teams = ["home_team", "away_team"]
    fields = ["final_home_score", "final_away_score", "closing_home_odds", "closing_draw_odds", "closing_away_odds"]
    cand = F.struct(F.col(order).alias("o"), *fields)
    exact = results.filter(F.col("kickoff").isNotNull()).groupBy(*teams, "kickoff").agg(F.min_by(cand, order).alias("__exact"))
    per_pair = results.groupBy(*teams).agg(
        F.min_by(F.when(F.col("kickoff").isNull(), cand), F.when(F.col("kickoff").isNull(), F.col(order))).alias("__blank"),
        F.min_by(cand, order).alias("__any"),
    )
    joined = ledger.join(exact, [*teams, "kickoff"], "left").join(per_pair, teams, "left")
    known = F.when(
        F.col("__exact").isNotNull() & (F.col("__blank").isNull() | (F.col("__exact.o") < F.col("__blank.o"))), F.col("__exact")
    ).otherwise(F.col("__blank"))
    hit = F.when(F.col("kickoff").isNull(), F.col("__any")).otherwise(known)
    open_row = F.col("final_outcome").isNull()
    out = joined.withColumn("__hit", F.when(open_row, hit)).drop("__exact", "__blank", "__any")
    outcome = P.outcome_label("__hit.final_home_score", "__hit.final_away_score")
    stake = F.coalesce(F.col("suggested_stake_amount"), F.lit(flat_stake))
    returned = P.realised_return("best_outcome", outcome, *_odds(), stake)
    out = out.withColumn("realized_return", F.coalesce(F.when(F.col("__hit").isNotNull(), returned), F.col("realized_return")))
    out = out.withColumn("final_outcome", F.coalesce(F.when(F.col("__hit").isNotNull(), outcome), F.col("final_outcome")))
    for name in fields:
        out = out.withColumn(name, F.coalesce(F.col("__hit")[name], F.col(name)))
    return out.drop("__hit")


def ledger_summary(ledger: DataFrame, group: list[str] = ()) -> DataFrame:
    """Counts, hit rate, flat and stake-weighted return, exposure and mean expectation of a ledger."""
    candidate = F.col("decision") == "candidate_edge"
    settled = F.col("final_outcome").isNotNull() & F.col("realized_return").isNotNull()
    both = candidate & settled
    stake = F.when(F.col("suggested_stake_amount") > 0, F.col("suggested_stake_amount")).otherwise(1.0)
    taken = P.pick("best_outcome", *_odds())
    closing = P.pick("best_outcome", F.col("closing_home_odds"), F.col("closing_draw_odds"), F.col("closing_away_odds"))
    flat = F.when(F.col("best_outcome") == F.col("final_outcome"), taken - 1.0).otherwise(-1.0)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(both, value)), F.lit(0.0))

    def mean(value: Column) -> Column:
        return F.coalesce(F.avg(F.when(both, value)), F.lit(0.0))

    out = ledger.groupBy(*group).agg(
        F.count("*").alias("total_predictions"), F.count_if(settled).alias("settled_predictions"),
        F.count_if(candidate).alias("candidate_edges_logged"), F.count_if(both).alias("settled_candidate_edges"),
        mean((F.col("best_outcome") == F.col("final_outcome")).cast("double")).alias("hit_rate"),
        total(F.col("realized_return")).alias("stake_weighted_return"), total(stake).alias("total_suggested_exposure"),
        total(flat).alias("flat_stake_return"), mean(F.col("best_expected_value")).alias("avg_expected_value"),
        mean(F.col("best_edge")).alias("avg_edge"), mean(taken - closing).alias("avg_closing_line_value"),
    )
    n = F.col("settled_candidate_edges")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        out.withColumn("stake_weighted_roi", ratio(F.col("stake_weighted_return"), F.col("total_suggested_exposure")))
        .withColumn("flat_stake_roi", ratio(F.col("flat_stake_return"), n))
        .withColumn("average_suggested_stake", ratio(F.col("total_suggested_exposure"), n))
    )


def clv_table(predictions: DataFrame) -> DataFrame:
    """Relative closing-line value and implied probabilities of the predicted outcome."""
    market = P.pick("predicted_outcome", F.col("market_home_odds"), F.col("market_draw_odds"), F.col("market_away_odds"))
    closing = P.pick("predicted_outcome", F.col("closing_home_odds"), F.col("closing_draw_odds"), F.col("closing_away_odds"))
    clv = P.closing_line_value(market, closing)
    return (
        predictions.withColumn("market_implied_probability", P.implied_probability(market))
        .withColumn("closing_implied_probability", P.implied_probability(closing))
        .withColumn("closing_line_value", clv).withColumn("closing_line_value_pct", clv * 100.0)
    )


def forecast_audit(forecasts: DataFrame, tie: list[str]) -> DataFrame:
    """Metric/value rows about a forecast table; ``tie`` fixes which of several extreme rows is named."""
    warned = F.trim(F.coalesce(F.col("rating_warning"), F.lit(""))) != ""
    alias = (F.col("home_rating_source") == "alias_lookup") | (F.col("away_rating_source") == "alias_lookup")
    name = F.concat_ws(" vs ", "home_team", "away_team")
    conf = F.col("model_confidence")
    low_key = F.struct(conf, *tie)
    high_key = F.struct((-conf).alias("c"), *tie)
    one = forecasts.agg(
        F.count("*").alias("n"), F.avg(conf).alias("mean"), F.max(conf).alias("hi"), F.min(conf).alias("lo"),
        F.min_by(name, high_key).alias("hi_name"), F.min_by(name, low_key).alias("lo_name"),
        F.count_if(warned).alias("warned"), F.count_if(alias).alias("alias"),
        *[F.count_if(F.col("predicted_outcome") == o).alias(f"n_{o}") for o in OUTCOMES],
    )
    number = lambda c: F.format_string("%.6f", F.col(c))
    entries = [("forecast_count", F.col("n").cast("string")), ("average_confidence", number("mean")),
               ("highest_confidence_match", F.col("hi_name")), ("highest_confidence", number("hi")),
               ("lowest_confidence_match", F.col("lo_name")), ("lowest_confidence", number("lo")),
               ("rating_warning_count", F.col("warned").cast("string")), ("alias_lookup_count", F.col("alias").cast("string"))]
    rows = [F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in entries]
    rows += [F.when(F.col(f"n_{o}") > 0, F.struct(F.lit(f"predicted_{o}_count").alias("metric"), F.col(f"n_{o}").cast("string").alias("value")))
             for o in OUTCOMES]
    return one.select(F.inline(F.array_compact(F.array(*rows))))


def most_confident(forecasts: DataFrame, k: int, tie: list[str], least: bool = False) -> DataFrame:
    conf = F.col("model_confidence")
    return forecasts.orderBy(conf.asc() if least else conf.desc(), *tie).limit(k)


def upset_watch(forecasts: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Matches whose lower-rated side has at least the threshold probability."""
    home_lower = F.col("home_rating") < F.col("away_rating")
    out = (
        forecasts.withColumn("lower_rated_team", F.when(home_lower, F.col("home_team")).otherwise(F.col("away_team")))
        .withColumn("higher_rated_team", F.when(home_lower, F.col("away_team")).otherwise(F.col("home_team")))
        .withColumn("rating_gap", F.abs(F.col("home_rating") - F.col("away_rating")))
        .withColumn("upset_probability", F.when(home_lower, F.col("prob_home_win")).otherwise(F.col("prob_away_win")))
    )
    return out.filter(F.col("upset_probability") >= threshold)


def portfolio_summary(ledger: DataFrame) -> DataFrame:
    status = F.lower(F.col("status"))
    return ledger.agg(
        F.count("*").alias("prediction_count"), F.count_if(status == "open").alias("open_count"),
        F.count_if(status == "settled").alias("settled_count"), F.avg("model_confidence").alias("average_confidence"),
        *[F.count_if(F.col("predicted_outcome") == o).alias(f"{o}_picks") for o in OUTCOMES],
    )


def standings(matches: DataFrame, group: list[str]) -> DataFrame:
    """League table per group from scored fixtures; rank by points, goal difference, goals, name."""
    from .history import team_rows

    scored = matches.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    rows = team_rows(scored, group)
    diff = F.col("goals_for") - F.col("goals_against")
    table = rows.groupBy(*group, "team_id").agg(
        F.count("*").alias("played"), F.count_if(diff > 0).alias("wins"), F.count_if(diff == 0).alias("draws"),
        F.count_if(diff < 0).alias("losses"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"),
        F.sum(diff).alias("goal_difference"), F.sum("points").alias("points"),
    )
    w = Window.partitionBy(*group).orderBy(
        F.col("points").desc(), F.col("goal_difference").desc(), F.col("goals_for").desc(), F.col("team_id"))
    return table.withColumn("rank", F.row_number().over(w))


def advancement(scenario_standings: DataFrame, group: list[str], scenario: str, qualifiers: int = 2) -> DataFrame:
    """How often each team finishes inside the qualifying ranks over many scenarios."""
    return scenario_standings.groupBy(*group, "team_id").agg(
        F.count_distinct(scenario).alias("simulations"),
        F.avg((F.col("rank") <= qualifiers).cast("double")).alias("advance_probability"),
        F.avg("points").alias("avg_points"), F.avg("goal_difference").alias("avg_goal_difference"),
        F.avg("goals_for").alias("avg_goals_for"),
    )
