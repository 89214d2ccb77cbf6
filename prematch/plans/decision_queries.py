"""Market decisions, ledger and reports (I*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r6
from ..functions import probability as P
from ..operators import decisions as D
from .bindings import Tables, ctes
from .registry import query
from .scalar_queries import ARGMAX_SQL, DECISION_SQL, EDGES_SQL

PRED = ctes("predictions")
ENT = "-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) / ln(3)"
CONF = f"CASE WHEN greatest(p_home, p_draw, p_away) >= 0.6 AND {ENT} <= 0.75 THEN 'High' WHEN greatest(p_home, p_draw, p_away) >= 0.45 THEN 'Medium' ELSE 'Low' END"
DIS = "greatest(abs(p_home - q_home), abs(p_draw - q_draw), abs(p_away - q_away))"
SLATE = f"{PRED}, slate AS (SELECT *, {DECISION_SQL} AS decision, {ENT} AS entropy, {CONF} AS confidence, {DIS} AS disagreement FROM ({EDGES_SQL}) AS d)"
POLICY = SLATE + """, pol AS (SELECT *, concat_ws(';', CASE WHEN decision <> 'candidate_edge' THEN 'decision_not_candidate_edge' END, CASE WHEN best_edge < 0.05 THEN 'edge_below_threshold' END,
     CASE WHEN best_expected_value < 0.05 THEN 'expected_value_below_threshold' END, CASE WHEN entropy > 1 THEN 'entropy_above_limit' END, CASE WHEN disagreement > 0.5 THEN 'model_disagreement_above_limit' END,
     CASE WHEN implied_total > 1.08 THEN 'market_overround_above_limit' END, CASE WHEN confidence NOT IN ('High', 'Medium') THEN 'confidence_not_allowed' END) AS why FROM slate)"""
STAKES = POLICY + """, k0 AS (SELECT *, CASE best_outcome WHEN 'home_win' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END AS bp, CASE best_outcome WHEN 'home_win' THEN home_odds WHEN 'draw' THEN draw_odds ELSE away_odds END AS bo FROM pol),
   k1 AS (SELECT *, CASE WHEN why = '' THEN ((bo - 1) * bp - (1 - bp)) / (bo - 1) ELSE 0 END AS kelly FROM k0), k2 AS (SELECT *, CASE WHEN why = '' AND kelly > 0 THEN least(kelly * 0.25, 0.02) ELSE 0e0 END AS s FROM k1),
   k3 AS (SELECT *, sum(s) OVER (PARTITION BY CAST(prediction_time AS DATE), model_id) AS total FROM k2),
   st AS (SELECT *, CASE WHEN total > 0.05 THEN s * 0.05 / total ELSE s END AS fraction, CASE WHEN why <> '' THEN 'not_actionable' WHEN kelly <= 0 THEN 'non_positive_kelly' WHEN s < kelly * 0.25 THEN 'single_bet_cap_applied' ELSE 'fractional_kelly' END
       || CASE WHEN total > 0.05 AND s > 0 THEN ';portfolio_cap_scaled' ELSE '' END AS reason FROM k3)"""


def slate(t: Tables):
    p = t.predictions
    odds = p.select("row_id", "model_id", "prediction_time", "actual", "home_id", "away_id", "home_odds", "draw_odds", "away_odds", "q_home", "q_draw", "q_away", "p_home", "p_draw", "p_away")
    priced = D.market_edges(odds).withColumn("ensemble_confidence", P.confidence_label(*P.triple())).withColumn("ensemble_entropy", P.entropy_normalised(*P.triple()))
    return priced.withColumn("max_model_disagreement", P.max_disagreement(P.triple(), P.triple("q_")))


def staked(t: Tables):
    return D.size_stakes(D.apply_policy(slate(t)).withColumn("day", F.to_date("prediction_time")), ["day", "model_id"])


# One forecast per match joined to every bookmaker quote of it.
@query("i1_slate_evaluation", ctes("forecasts", "quotes") + f""", predictions AS (SELECT q.record_id AS row_id, NULL AS prediction_time, f.p_home, f.p_draw, f.p_away, q.home_odds, q.draw_odds, q.away_odds, 0 AS home_id, 0 AS away_id, '' AS actual, '' AS model_id, 0 AS q_home, 0 AS q_draw, 0 AS q_away
     FROM quotes q JOIN forecasts f ON q.match_id = f.match_id)
   SELECT row_id, best_outcome, round(best_edge, 6) + 0.0 AS best_edge, round(best_expected_value, 6) + 0.0 AS best_expected_value, {DECISION_SQL} AS decision, {CONF} AS confidence FROM ({EDGES_SQL}) AS d""")
def i1(t: Tables):
    q = t.view("quotes").select("match_id", F.col("record_id").alias("row_id"), "home_odds", "draw_odds", "away_odds")
    e = D.evaluate_slate(t.view("forecasts"), q, ["match_id"])
    return e.select("row_id", "best_outcome", r6("best_edge").alias("best_edge"), r6("best_expected_value").alias("best_expected_value"), "decision", F.col("ensemble_confidence").alias("confidence"))


@query("i2_strategy_policy", POLICY + " SELECT row_id, model_id, CASE WHEN why = '' THEN 'actionable' ELSE 'filtered' END AS action, CASE WHEN why = '' THEN 'passes_policy' ELSE why END AS reason FROM pol")
def i2(t: Tables):
    return D.apply_policy(slate(t)).select("row_id", "model_id", F.col("strategy_action").alias("action"), F.col("strategy_reason").alias("reason"))


@query("i3_stake_sizing", STAKES + " SELECT row_id, model_id, round(kelly, 6) + 0.0 AS kelly, round(fraction, 6) + 0.0 AS fraction, round(fraction * 1000, 4) + 0.0 AS amount, reason FROM st")
def i3(t: Tables):
    s = staked(t)
    return s.select("row_id", "model_id", r6("full_kelly_fraction").alias("kelly"), r6("suggested_stake_fraction").alias("fraction"), (F.round("suggested_stake_amount", 4) + F.lit(0.0)).alias("amount"), F.col("stake_sizing_reason").alias("reason"))


@query("i4_ledger_append", STAKES + " SELECT row_id, model_id, best_outcome, round(fraction, 6) + 0.0 AS fraction, CAST(NULL AS VARCHAR) AS final_outcome FROM st WHERE why = ''")
def i4(t: Tables):
    return D.to_ledger(staked(t)).select("row_id", "model_id", "best_outcome", r6("suggested_stake_fraction").alias("fraction"), "final_outcome")


# Ledger rows name teams and sometimes a kickoff day; results are the matches in id order, some without a kickoff.
LEDGER_SQL = STAKES + """, led AS (SELECT row_id, model_id, home_id AS home_team, away_id AS away_team, CASE WHEN row_id % 3 = 0 THEN NULL ELSE row_id % 40 END AS kickoff, best_outcome, best_edge, best_expected_value, decision, home_odds, draw_odds, away_odds, fraction * 1000 AS stake,
     CASE WHEN row_id % 17 = 0 THEN 'draw' END AS final_outcome, CASE WHEN row_id % 17 = 0 THEN 1e0 END AS realized_return FROM st WHERE decision = 'candidate_edge'),
   res AS (SELECT o_orderkey AS ord, o_custkey % 97 AS home_team, (o_custkey % 97 + 1 + o_orderkey % 96) % 97 AS away_team, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 40 END AS kickoff, CAST(floor(o_totalprice) AS BIGINT) % 5 AS hs, CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS as_, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 + o_orderkey % 7 END AS ch FROM orders),
   hit AS (SELECT * FROM (SELECT l.*, r.hs, r.as_, r.ch, r.ord, row_number() OVER (PARTITION BY l.row_id, l.model_id, l.home_odds, l.draw_odds, l.away_odds, l.best_edge ORDER BY r.ord) AS rn FROM led l LEFT JOIN res r ON l.home_team = r.home_team AND l.away_team = r.away_team
     AND (r.kickoff IS NULL OR l.kickoff IS NULL OR l.kickoff = r.kickoff) AND l.final_outcome IS NULL) WHERE rn = 1),
   settled AS (SELECT row_id, model_id, decision, best_outcome, best_edge, best_expected_value, home_odds, draw_odds, away_odds, stake, ch,
     CASE WHEN ord IS NULL THEN final_outcome WHEN hs > as_ THEN 'home_win' WHEN hs < as_ THEN 'away_win' ELSE 'draw' END AS final_outcome, ord IS NULL AS untouched, realized_return FROM hit),
   done AS (SELECT *, CASE best_outcome WHEN 'home_win' THEN home_odds WHEN 'draw' THEN draw_odds ELSE away_odds END AS taken, CASE WHEN untouched THEN realized_return WHEN stake <= 0 THEN NULL WHEN best_outcome = final_outcome THEN stake * (CASE best_outcome WHEN 'home_win' THEN home_odds WHEN 'draw' THEN draw_odds ELSE away_odds END - 1) ELSE -stake END AS ret FROM settled)"""


def ledger(t: Tables):
    s = D.to_ledger(staked(t).filter("decision = 'candidate_edge'"), False)
    old = F.col("row_id") % 17 == 0
    return (
        s.withColumn("home_team", F.col("home_id")).withColumn("away_team", F.col("away_id"))
        .withColumn("kickoff", F.when(F.col("row_id") % 3 != 0, F.col("row_id") % 40))
        .withColumn("final_outcome", F.when(old, F.lit("draw"))).withColumn("realized_return", F.when(old, F.lit(1.0))))


def results(t: Tables):
    m, k = t.matches, F.col("match_id")
    return m.select(k.alias("ord"), F.col("home_id").alias("home_team"), F.col("away_id").alias("away_team"), F.when(k % 5 != 0, k % 40).alias("kickoff"),
                    F.col("home_score").cast("int").alias("final_home_score"), F.col("away_score").cast("int").alias("final_away_score"),
                    F.when(k % 2 == 0, 1.5 + k % 7).cast("double").alias("closing_home_odds"), F.lit(None).cast("double").alias("closing_draw_odds"), F.lit(None).cast("double").alias("closing_away_odds"))


def settled(t: Tables):
    return D.settle(ledger(t), results(t), "ord")


@query("i5_settlement", LEDGER_SQL + " SELECT row_id, model_id, best_outcome, final_outcome, round(ret, 6) + 0.0 AS realized_return, CAST(ch AS DOUBLE) AS closing_home_odds FROM done")
def i5(t: Tables):
    return settled(t).select("row_id", "model_id", "best_outcome", "final_outcome", r6("realized_return").alias("realized_return"), "closing_home_odds")


@query("i6_ledger_summary", LEDGER_SQL + """, c AS (SELECT *, final_outcome IS NOT NULL AND ret IS NOT NULL AS ok, CASE WHEN stake > 0 THEN stake ELSE 1 END AS st2 FROM done)
   SELECT model_id, count(*) AS total_predictions, count(*) FILTER (WHERE ok) AS settled_predictions, count(*) FILTER (WHERE ok) AS settled_candidate_edges, round(avg(CASE WHEN best_outcome = final_outcome THEN 1e0 ELSE 0e0 END) FILTER (WHERE ok), 6) + 0.0 AS hit_rate,
     round(sum(ret) FILTER (WHERE ok), 3) + 0.0 AS stake_weighted_return, round(sum(ret) FILTER (WHERE ok) / sum(st2) FILTER (WHERE ok), 6) + 0.0 AS stake_weighted_roi,
     round(sum(CASE WHEN best_outcome = final_outcome THEN taken - 1 ELSE -1 END) FILTER (WHERE ok) / count(*) FILTER (WHERE ok), 6) + 0.0 AS flat_stake_roi, round(avg(best_edge) FILTER (WHERE ok), 6) + 0.0 AS avg_edge,
     round(coalesce(avg(taken - CASE WHEN best_outcome = 'home_win' THEN ch END) FILTER (WHERE ok), 0), 6) + 0.0 AS avg_closing_line_value FROM c GROUP BY model_id""")
def i6(t: Tables):
    s = D.ledger_summary(settled(t), ["model_id"])
    return s.select("model_id", "total_predictions", "settled_predictions", "settled_candidate_edges", (F.round("stake_weighted_return", 3) + F.lit(0.0)).alias("stake_weighted_return"),
                    *[r6(c).alias(c) for c in ("hit_rate", "stake_weighted_roi", "flat_stake_roi", "avg_edge", "avg_closing_line_value")])


@query("i7_closing_line_value", f"""{PRED}, c AS (SELECT row_id, model_id, {ARGMAX_SQL.format('p_')} AS o, home_odds, draw_odds, away_odds, home_odds * 0.9 + 0.05 AS ch, draw_odds * 1.1 - 0.3 AS cd, away_odds * 0.7 AS ca FROM predictions),
   s AS (SELECT row_id, model_id, o, CASE o WHEN 'home_win' THEN home_odds WHEN 'draw' THEN draw_odds ELSE away_odds END AS m, CASE o WHEN 'home_win' THEN ch WHEN 'draw' THEN cd ELSE ca END AS c FROM c)
   SELECT row_id, model_id, o AS predicted_outcome, round(CASE WHEN m > 1 AND c > 1 THEN m / c - 1 END, 6) + 0.0 AS clv, round(CASE WHEN c > 1 THEN 1 / c END, 6) + 0.0 AS closing_implied FROM s""")
def i7(t: Tables):
    p = t.predictions.withColumn("predicted_outcome", P.argmax_outcome(*P.triple()))
    p = p.withColumns({"market_home_odds": F.col("home_odds"), "market_draw_odds": F.col("draw_odds"), "market_away_odds": F.col("away_odds"),
                       "closing_home_odds": F.col("home_odds") * 0.9 + 0.05, "closing_draw_odds": F.col("draw_odds") * 1.1 - 0.3, "closing_away_odds": F.col("away_odds") * 0.7})
    c = D.clv_table(p)
    return c.select("row_id", "model_id", "predicted_outcome", r6("closing_line_value").alias("clv"), r6("closing_implied_probability").alias("closing_implied"))


FORE_SQL = ctes("matches", "forecasts") + f""", fc AS (SELECT m.match_id, 'T' || home_id AS home_team, 'T' || away_id AS away_team, home_id * 11e0 + 1000 AS home_rating, away_id * 11e0 + 1000 AS away_rating, p_home, p_draw, p_away, {ARGMAX_SQL.format('p_')} AS predicted_outcome, greatest(p_home, p_draw, p_away) AS conf,
     CASE WHEN home_id % 10 = 0 THEN 'alias_lookup' WHEN home_id % 10 = 1 THEN 'fallback_1500' ELSE 'rating_lookup' END AS hs FROM matches m JOIN forecasts f ON m.match_id = f.match_id WHERE status = 'scheduled')"""


def forecast_rows(t: Tables):
    name = lambda c: F.concat(F.lit("T"), F.col(c))
    rows = t.matches.filter("status = 'scheduled'").join(t.view("forecasts"), "match_id")
    kind = F.col("home_id") % 10
    return rows.select(
        "match_id", name("home_id").alias("home_team"), name("away_id").alias("away_team"), (F.col("home_id") * 11.0 + 1000).alias("home_rating"), (F.col("away_id") * 11.0 + 1000).alias("away_rating"),
        F.col("p_home").alias("prob_home_win"), F.col("p_draw").alias("prob_draw"), F.col("p_away").alias("prob_away_win"), P.argmax_outcome(*P.triple()).alias("predicted_outcome"),
        F.greatest(*P.triple()).alias("model_confidence"), F.when(kind == 0, F.lit("alias_lookup")).when(kind == 1, F.lit("fallback_1500")).otherwise(F.lit("rating_lookup")).alias("home_rating_source"),
        F.lit("rating_lookup").alias("away_rating_source"), F.when(kind == 1, F.lit("fallback_rating_used")).alias("rating_warning"))


@query("i8_forecast_audit", FORE_SQL + """, a AS (SELECT count(*) AS n, avg(conf) AS m, max(conf) AS hi, min(conf) AS lo, arg_min(home_team || ' vs ' || away_team, (-conf, match_id)) AS hn, arg_min(home_team || ' vs ' || away_team, (conf, match_id)) AS ln,
     count(*) FILTER (WHERE hs = 'fallback_1500') AS w, count(*) FILTER (WHERE hs = 'alias_lookup') AS al, count(*) FILTER (WHERE predicted_outcome = 'home_win') AS ch, count(*) FILTER (WHERE predicted_outcome = 'draw') AS cd, count(*) FILTER (WHERE predicted_outcome = 'away_win') AS ca FROM fc)
   SELECT 'forecast_count' AS metric, CAST(n AS VARCHAR) AS value FROM a UNION ALL SELECT 'average_confidence', printf('%.6f', m) FROM a UNION ALL SELECT 'highest_confidence_match', hn FROM a UNION ALL SELECT 'highest_confidence', printf('%.6f', hi) FROM a
   UNION ALL SELECT 'lowest_confidence_match', ln FROM a UNION ALL SELECT 'lowest_confidence', printf('%.6f', lo) FROM a UNION ALL SELECT 'rating_warning_count', CAST(w AS VARCHAR) FROM a UNION ALL SELECT 'alias_lookup_count', CAST(al AS VARCHAR) FROM a
   UNION ALL SELECT 'predicted_home_win_count', CAST(ch AS VARCHAR) FROM a WHERE ch > 0 UNION ALL SELECT 'predicted_draw_count', CAST(cd AS VARCHAR) FROM a WHERE cd > 0 UNION ALL SELECT 'predicted_away_win_count', CAST(ca AS VARCHAR) FROM a WHERE ca > 0""")
def i8(t: Tables):
    return D.forecast_audit(forecast_rows(t), ["match_id"])


@query("i9_most_confident", FORE_SQL + " SELECT match_id, round(conf, 6) + 0.0 AS confidence FROM fc ORDER BY conf DESC, match_id LIMIT 25")
def i9(t: Tables):
    return D.most_confident(forecast_rows(t), 25, ["match_id"]).select("match_id", r6("model_confidence").alias("confidence"))


@query("i9_upset_watch", FORE_SQL + """ SELECT match_id, CASE WHEN home_rating < away_rating THEN home_team ELSE away_team END AS lower_rated_team, abs(home_rating - away_rating) AS rating_gap, round(CASE WHEN home_rating < away_rating THEN p_home ELSE p_away END, 6) + 0.0 AS upset_probability
   FROM fc WHERE CASE WHEN home_rating < away_rating THEN p_home ELSE p_away END >= 0.3""")
def i9_upsets(t: Tables):
    return D.upset_watch(forecast_rows(t), 0.3).select("match_id", "lower_rated_team", "rating_gap", r6("upset_probability").alias("upset_probability"))


@query("i10_portfolio_summary", FORE_SQL + """ SELECT count(*) AS prediction_count, count(*) FILTER (WHERE match_id % 3 <> 0) AS open_count, count(*) FILTER (WHERE match_id % 3 = 0) AS settled_count, round(avg(conf), 6) + 0.0 AS average_confidence,
   count(*) FILTER (WHERE predicted_outcome = 'home_win') AS home_win_picks, count(*) FILTER (WHERE predicted_outcome = 'draw') AS draw_picks, count(*) FILTER (WHERE predicted_outcome = 'away_win') AS away_win_picks FROM fc""")
def i10(t: Tables):
    rows = forecast_rows(t).withColumn("status", F.when(F.col("match_id") % 3 == 0, F.lit("Settled")).otherwise(F.lit("open")))
    return D.portfolio_summary(rows).withColumn("average_confidence", r6("average_confidence"))


TABLE_SQL = """, r AS (SELECT {g}, home_id AS team_id, home_score AS gf, away_score AS ga FROM matches WHERE status = 'completed' UNION ALL SELECT {g}, away_id, away_score, home_score FROM matches WHERE status = 'completed'),
   tb AS (SELECT {g}, team_id, count(*) AS played, count(*) FILTER (WHERE gf > ga) AS wins, count(*) FILTER (WHERE gf = ga) AS draws, count(*) FILTER (WHERE gf < ga) AS losses, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against, CAST(sum(gf - ga) AS BIGINT) AS goal_difference,
     CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points FROM r GROUP BY {g}, team_id), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY {g} ORDER BY points DESC, goal_difference DESC, goals_for DESC, team_id) AS INTEGER) AS rank FROM tb)"""


@query("i11_standings", ctes("matches") + TABLE_SQL.format(g="competition_id") + " SELECT * FROM rk")
def i11(t: Tables):
    return D.standings(t.matches.filter("status = 'completed'"), ["competition_id"])


# Every year is one scenario of the same competition.
@query("i12_advancement", ctes("matches").replace("competition_id,", "competition_id,", 1) + ", yr AS (SELECT *, CAST(year(match_date) AS INTEGER) AS season FROM matches)" + TABLE_SQL.format(g="competition_id, season").replace("FROM matches", "FROM yr") + """ SELECT competition_id, team_id, count(DISTINCT season) AS simulations,
   round(avg(CASE WHEN rank <= 8 THEN 1e0 ELSE 0e0 END), 6) + 0.0 AS advance_probability, round(avg(points), 6) + 0.0 AS avg_points, round(avg(goal_difference), 6) + 0.0 AS avg_goal_difference FROM rk GROUP BY competition_id, team_id""")
def i12(t: Tables):
    scenarios = D.standings(t.matches.filter("status = 'completed'").withColumn("season", F.year("match_date")), ["competition_id", "season"])
    out = D.advancement(scenarios, ["competition_id"], "season", 8)
    return out.select("competition_id", "team_id", "simulations", *[r6(c).alias(c) for c in ("advance_probability", "avg_points", "avg_goal_difference")])


