"""Feature families and datasets (E*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.common import epoch, r6
from ..operators import assemble as M
from ..operators import features as X
from ..operators import history as H
from .bindings import Tables, ctes
from .quality_queries import CONTENT_SUM
from .registry import query

SIDES = ctes("matches", "eligible", "sides")
PTS = "CASE WHEN h.gf > h.ga THEN 3 WHEN h.gf = h.ga THEN 1 ELSE 0 END"
# the newest eligible results of the team of every (match, side)
PAST = SIDES + """, tops AS MATERIALIZED (SELECT t.match_id, t.side, max(struct_pack(d := h.match_date, nk := h.kickoff_at IS NULL, k := h.kickoff_at, ref := h.match_id, gf := h.gf, ga := h.ga), 20) AS l
     FROM sides t JOIN sides h ON t.team_id = h.team_id AND h.eligible_at <= t.prediction_time GROUP BY t.match_id, t.side),
   past AS MATERIALIZED (SELECT match_id, side, u.ref AS ref, u.gf AS gf, u.ga AS ga, u.k AS k, u.d AS d, rn FROM (SELECT match_id, side, unnest(l) AS u, generate_subscripts(l, 1) AS rn FROM tops))"""


def _form_sql(n: int, rates: bool = False) -> str:
    f = f"FILTER (WHERE h.rn <= {n})"
    out = f"""CAST(count(h.ref) {f} AS INTEGER) AS used_{n}, round(avg({PTS}) {f}, 6) + 0.0 AS points_{n}, round(avg(h.gf - h.ga) {f}, 6) + 0.0 AS goal_diff_{n},
      round(avg(h.gf) {f}, 6) + 0.0 AS goals_for_{n}, round(avg(h.ga) {f}, 6) + 0.0 AS goals_against_{n}"""
    if rates:
        out += f""", round(avg(CASE WHEN h.ga = 0 THEN 1 ELSE 0 END) {f}, 6) + 0.0 AS clean_sheet_{n}, round(avg(CASE WHEN h.gf = 0 THEN 1 ELSE 0 END) {f}, 6) + 0.0 AS failed_to_score_{n}"""
    return out


def _form_columns(windows, rates=False):
    names = ["points", "goal_diff", "goals_for", "goals_against", *(["clean_sheet", "failed_to_score"] if rates else [])]
    return [c for n in windows for c in [F.col(f"used_{n}"), *[r6(f"{m}_{n}").alias(f"{m}_{n}") for m in names]]]


@query("e1_rolling_form", f"{PAST} SELECT t.match_id, t.side, t.team_id, {_form_sql(5)}, {_form_sql(10)} FROM sides t LEFT JOIN past h ON t.match_id = h.match_id AND t.side = h.side GROUP BY ALL")
def e1(t: Tables):
    history = H.recent_history(t.eligible, 10)
    return X.form(history, (5, 10)).select("match_id", "side", "team_id", *_form_columns((5, 10)))


@query("e2_extended_form", f"{PAST} SELECT t.match_id, t.side, {_form_sql(5, True)}, {_form_sql(10, True)}, {_form_sql(20, True)} FROM sides t LEFT JOIN past h ON t.match_id = h.match_id AND t.side = h.side GROUP BY ALL")
def e2(t: Tables):
    history = H.recent_history(t.eligible, 20)
    return X.form(history, (5, 10, 20), True).select("match_id", "side", *_form_columns((5, 10, 20), True))


def _replay_sql(n: int) -> str:
    w = f"OVER (PARTITION BY team_id ORDER BY match_date, home_id, away_id, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    pts = "CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END"
    return ", ".join(f"round(coalesce(avg({v}) {w}, {d}e0), 6) + 0.0 AS form_{n}_{c}_per_match" for c, v, d in (
        ("points", pts, 1), ("goal_diff", "gf - ga", 0), ("goals_for", "gf", 1), ("goals_against", "ga", 1)))


REPLAY_ROWS = ctes("matches") + """, r AS (SELECT match_id, match_date, home_id, away_id, 'home' AS side, home_id AS team_id, home_score AS gf, away_score AS ga FROM matches WHERE status = 'completed'
   UNION ALL SELECT match_id, match_date, home_id, away_id, 'away', away_id, away_score, home_score FROM matches WHERE status = 'completed')"""


@query("e3_form_with_defaults", f"{REPLAY_ROWS} SELECT match_id, side, {_replay_sql(5)}, {_replay_sql(10)} FROM r")
def e3(t: Tables):
    out = X.replay_form(t.matches.filter("status = 'completed'"))
    return out.select("match_id", "side", *[r6(c).alias(c) for c in out.columns if c.startswith("form_")])


def long(df):
    return df.select("match_id", "feature", r6("value").alias("value"), "status", "reason")


REST_SQL = PAST + """, x AS MATERIALIZED (SELECT t.match_id, t.side, CASE WHEN h.ref IS NULL THEN NULL WHEN t.kickoff_at IS NOT NULL AND h.k IS NOT NULL THEN (epoch_us(t.kickoff_at) - epoch_us(h.k)) / 86400000000.0
     ELSE CAST(date_diff('day', h.d, t.match_date) AS DOUBLE) END AS days,
     CASE WHEN h.ref IS NULL THEN 'no_history' WHEN t.kickoff_at IS NULL OR h.k IS NULL THEN 'temporal_precision' END AS why FROM sides t LEFT JOIN past h ON t.match_id = h.match_id AND t.side = h.side AND h.rn = 1),
   p AS (SELECT h.match_id, h.days AS hd, h.why AS hw, a.days AS ad, a.why AS aw FROM x h JOIN x a ON h.match_id = a.match_id AND h.side = 'home' AND a.side = 'away')"""


@query("e4_rest_days", REST_SQL + """ SELECT match_id, f AS feature, round(CASE f WHEN 'schedule.home.rest_days' THEN hd WHEN 'schedule.away.rest_days' THEN ad ELSE hd - ad END, 6) + 0.0 AS value,
   CASE WHEN (CASE f WHEN 'schedule.home.rest_days' THEN hd WHEN 'schedule.away.rest_days' THEN ad ELSE hd - ad END) IS NULL THEN 'missing'
     WHEN (CASE f WHEN 'schedule.home.rest_days' THEN hw WHEN 'schedule.away.rest_days' THEN aw ELSE coalesce(hw, aw) END) IS NOT NULL THEN 'imputed' ELSE 'observed' END AS status,
   CASE f WHEN 'schedule.home.rest_days' THEN hw WHEN 'schedule.away.rest_days' THEN aw ELSE CASE WHEN hd - ad IS NULL THEN coalesce(hw, aw) WHEN hw IS NOT NULL OR aw IS NOT NULL THEN 'temporal_precision' END END AS reason
   FROM p, (VALUES ('schedule.home.rest_days'), ('schedule.away.rest_days'), ('schedule.rest_days_diff_home_minus_away')) AS v(f)""")
def e4(t: Tables):
    return long(X.rest(H.recent_history(t.eligible, 1), t.eligible))


# Snapshots stand in for replayed ratings: any dated rating per team will do for the as-of read.
SNAP_SQL = SIDES + """, snap AS (SELECT team_id, match_id, match_date, 1500 + gf * 7 - ga * 5 AS rating FROM sides WHERE status = 'completed'),
   best AS (SELECT t.match_id, t.side, arg_max(s.rating, (s.match_date, s.match_id)) AS rating FROM sides t JOIN snap s ON t.team_id = s.team_id AND s.match_date < CAST(t.prediction_time AS DATE) GROUP BY t.match_id, t.side),
   x AS (SELECT e.match_id, coalesce(h.rating, 1500) AS h, coalesce(a.rating, 1500) AS a, h.rating IS NOT NULL AS hk, a.rating IS NOT NULL AS ak, CASE WHEN neutral THEN 0 ELSE 75 END AS adv
     FROM eligible e LEFT JOIN best h ON e.match_id = h.match_id AND h.side = 'home' LEFT JOIN best a ON e.match_id = a.match_id AND a.side = 'away')"""


@query("e5_rating_features", SNAP_SQL + """, y AS (SELECT *, 1 / (1 + pow(10, (a - h - adv) / 400e0)) AS ex FROM x)
   SELECT match_id, f AS feature, round(CASE f WHEN 'elo.home_rating' THEN h WHEN 'elo.away_rating' THEN a WHEN 'elo.rating_diff_home_minus_away' THEN h - a WHEN 'elo.expected_home_score' THEN ex ELSE 1 - ex END, 6) + 0.0 AS value,
   CASE WHEN (f = 'elo.home_rating' AND hk) OR (f = 'elo.away_rating' AND ak) OR (hk AND ak) THEN 'observed' ELSE 'imputed' END AS status,
   CASE WHEN (f = 'elo.home_rating' AND hk) OR (f = 'elo.away_rating' AND ak) OR (hk AND ak) THEN NULL ELSE 'no_history' END AS reason
   FROM y, (VALUES ('elo.home_rating'), ('elo.away_rating'), ('elo.rating_diff_home_minus_away'), ('elo.expected_home_score'), ('elo.expected_away_score')) AS v(f)""")
def e5(t: Tables):
    rows = H.team_rows(t.eligible.filter("status = 'completed'"))
    snaps = rows.select("team_id", "match_id", F.col("match_date").alias("effective_date"), F.col("match_id").alias("snapshot_order"),
                        (1500.0 + F.col("goals_for") * 7 - F.col("goals_against") * 5).alias("rating"))
    return long(X.rating_features(t.eligible, snaps))


def published_ratings(t: Tables):
    """Elo features from ratings that count only once every result behind them was published."""
    from ..operators import ratings as R

    completed = t.eligible.filter("eligible_at IS NOT NULL")
    snaps = R.with_publication(R.elo_snapshots(R.elo_history(completed)), completed, "usable_at")
    return X.rating_features(t.eligible, snaps)


@query("e6_strength_features")
def e6(t: Tables):
    from ..operators import ratings as R

    completed = t.eligible.filter("eligible_at IS NOT NULL")
    glicko = R.with_publication(R.glicko_history(completed), completed)
    return long(M.assemble([published_ratings(t), X.glicko_features(t.eligible, glicko)]))


# No feature may name a result that was not published at its cutoff.
@query("e6_strength_leaks", ctes("matches", "eligible") + """, n AS (SELECT count(*) AS n FROM eligible)
   SELECT f AS feature, n AS rows_checked, 0::BIGINT AS leaks FROM n, (VALUES ('elo.home_rating'), ('elo.away_rating'), ('elo.rating_diff_home_minus_away'), ('elo.expected_home_score'), ('elo.expected_away_score')) AS v(f)""")
def e6_leaks(t: Tables):
    from ..operators.asof import lineage_leaks

    features = published_ratings(t)
    dated = features if "prediction_time" in features.columns else features.join(t.eligible.select("match_id", "prediction_time"), "match_id")
    leaks = lineage_leaks(dated, t.eligible.select(F.col("match_id").cast("string").alias("match_id"), "eligible_at"))
    counts = leaks.groupBy("feature").agg(F.count("*").alias("leaks"))
    checked = features.groupBy("feature").agg(F.count("*").alias("rows_checked"))
    return checked.join(counts, "feature", "left").select("feature", "rows_checked", F.coalesce("leaks", F.lit(0)).alias("leaks"))


def competitions(t: Tables):
    # every competition is in the catalog; one of them under a code that no match names
    code = F.when(F.col("competition_id") == "5-LOW", F.lit("retired")).otherwise(F.col("competition_id"))
    return t.matches.select("competition_id").distinct().select(
        code.alias("competition_id"), F.when(F.col("competition_id") == "4-NOT SPECIFIED", F.lit("friendly")).when(F.col("competition_id") == "1-URGENT", F.lit("world_cup")).otherwise(F.lit("nations_league")).alias("kind"),
        F.when(F.col("competition_id") == "3-MEDIUM", F.lit("UEFA")).alias("confederation"))


def stages(t: Tables):
    names = F.array(*[F.lit(s) for s in X.STAGES])
    leg = F.when(F.col("record_id") % 3 != 0, F.col("record_id") % 3)
    # some records name a match that does not exist, so that its own has none
    match = F.when(F.col("match_id") % 6 == 1, -1 - F.col("match_id")).otherwise(F.col("match_id"))
    return t.players.select(match.alias("match_id"), "record_id", "available_at", "leakage_risk", leg.alias("leg_number"),
                            F.element_at(names, (F.col("record_id") % 5 + 1).cast("int")).alias("stage"))


@query("e7_competition_context", ctes("matches", "eligible", "players") + """, st AS (SELECT CASE WHEN match_id % 6 = 1 THEN -1 - match_id ELSE match_id END AS match_id, record_id, available_at, leakage_risk FROM players),
   best AS (SELECT e.match_id, arg_max(s.record_id, (s.available_at, s.record_id)) AS rid FROM eligible e JOIN st s ON e.match_id = s.match_id AND s.leakage_risk = 'safe' AND s.available_at <= e.prediction_time GROUP BY e.match_id)
   SELECT e.match_id, CASE WHEN competition_id = '5-LOW' THEN NULL WHEN competition_id = '4-NOT SPECIFIED' THEN 1e0 ELSE 0e0 END AS friendly,
     CASE WHEN competition_id = '5-LOW' THEN NULL WHEN competition_id = '3-MEDIUM' THEN 1e0 ELSE 0e0 END AS confed,
     CASE WHEN rid IS NULL THEN NULL WHEN rid % 5 = 1 THEN 1e0 ELSE 0e0 END AS knockout, CAST(CASE WHEN rid % 3 <> 0 THEN rid % 3 END AS DOUBLE) AS leg,
     CASE WHEN rid IS NOT NULL AND rid % 3 <> 0 THEN NULL WHEN rid IS NOT NULL THEN 'not_applicable' WHEN e.match_id IN (SELECT match_id FROM st) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS leg_reason
   FROM eligible e LEFT JOIN best b ON e.match_id = b.match_id""")
def e7(t: Tables):
    f = X.competition_features(t.eligible, competitions(t), stages(t))
    one = lambda name, c="value": F.max(F.when(F.col("feature") == name, F.col(c)))
    return f.groupBy("match_id").agg(
        one("competition.kind.friendly").alias("friendly"), one("competition.confederation_specific").alias("confed"),
        one("competition.stage.knockout").alias("knockout"), one("competition.leg_number").alias("leg"), one("competition.leg_number", "reason").alias("leg_reason"))


# Fixtures of the events table: each purchase is a fixture whose cutoff is its own time.
EVENT_FIX = ctes("observations") + """, fx AS (SELECT record_id AS match_id, team_id AS home_id, (team_id + 1 + record_id % 96) % 97 AS away_id, available_at AS prediction_time, record_id % 3 = 0 AS neutral,
     record_id % 40 AS venue_id FROM observations WHERE source = 'purchase'),
   ob AS (SELECT * REPLACE (CASE WHEN team_id IN (13, 14) THEN -team_id ELSE team_id END AS team_id) FROM observations WHERE source <> 'purchase'),
   fs AS (SELECT match_id, 'home' AS side, home_id AS team_id, prediction_time FROM fx UNION ALL SELECT match_id, 'away', away_id, prediction_time FROM fx),
   best AS (SELECT f.match_id, f.side, arg_max(o.record_id, (o.available_at, o.record_id)) AS rid FROM fs f JOIN ob o ON f.team_id = o.team_id AND o.available_at <= f.prediction_time AND o.leakage_risk = 'safe' GROUP BY 1, 2),
   got AS (SELECT f.match_id, f.side, f.prediction_time, CASE WHEN f.prediction_time - o.available_at > INTERVAL 3 DAY THEN NULL ELSE o.record_id END AS rid, o.rank, o.points,
     CASE WHEN o.record_id IS NULL THEN CASE WHEN f.team_id IN (SELECT team_id FROM ob) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END WHEN f.prediction_time - o.available_at > INTERVAL 3 DAY THEN 'stale' END AS why
     FROM fs f LEFT JOIN best b ON f.match_id = b.match_id AND f.side = b.side LEFT JOIN ob o ON o.record_id = b.rid)"""


def event_fixtures(t: Tables):
    return t.observations.filter("source = 'purchase'").select(
        F.col("record_id").alias("match_id"), F.col("team_id").alias("home_id"), ((F.col("team_id") + 1 + F.col("record_id") % 96) % 97).alias("away_id"),
        F.col("available_at").alias("prediction_time"), (F.col("record_id") % 3 == 0).alias("neutral"), (F.col("record_id") % 40).alias("venue_id"))


def event_observations(t: Tables):
    # two teams' observations stand under ids that play no fixture
    return t.observations.filter("source <> 'purchase'").withColumn("team_id", F.when(F.col("team_id").isin(13, 14), -F.col("team_id")).otherwise(F.col("team_id")))


@query("e8_ranking_features", EVENT_FIX + """, p AS (SELECT h.match_id, CASE WHEN h.rid IS NOT NULL THEN h.rank END AS hr, CASE WHEN h.rid IS NOT NULL THEN h.points END AS hp, h.why AS hw, CASE WHEN a.rid IS NOT NULL THEN a.rank END AS ar,
     CASE WHEN a.rid IS NOT NULL THEN a.points END AS ap, a.why AS aw FROM got h JOIN got a ON h.match_id = a.match_id AND h.side = 'home' AND a.side = 'away'),
   l AS (SELECT match_id, unnest(['ranking.home.rank', 'ranking.home.points', 'ranking.away.rank', 'ranking.away.points', 'ranking.rank_diff_home_minus_away', 'ranking.points_diff_home_minus_away']) AS feature,
     unnest([CAST(hr AS DOUBLE), hp, CAST(ar AS DOUBLE), ap, CAST(hr - ar AS DOUBLE), hp - ap]) AS value,
     unnest([hw, coalesce(hw, 'upstream_unavailable'), aw, coalesce(aw, 'upstream_unavailable'), CASE WHEN hr IS NULL THEN hw ELSE aw END, CASE WHEN hp IS NULL THEN coalesce(hw, 'upstream_unavailable') ELSE coalesce(aw, 'upstream_unavailable') END]) AS why FROM p)
   SELECT match_id, feature, round(value, 6) + 0.0 AS value, CASE WHEN value IS NULL THEN 'missing' ELSE 'observed' END AS status, CASE WHEN value IS NULL THEN why END AS reason FROM l""")
def e8(t: Tables):
    return long(X.ranking_features(event_fixtures(t), event_observations(t), 3))


@query("e9_ranking_trends", EVENT_FIX + """, pv AS (SELECT record_id, source, available_at, rank, points, lag(source) OVER w AS ps, lag(rank) OVER w AS pr, lag(points) OVER w AS pp, lag(available_at) OVER w AS pa FROM ob WHERE leakage_risk = 'safe'
     WINDOW w AS (PARTITION BY team_id ORDER BY available_at, record_id)),
   j AS (SELECT g.match_id, g.side, g.rid, g.why, v.rank, v.points, CASE WHEN v.ps = v.source THEN v.pr END AS pr, CASE WHEN v.ps = v.source THEN v.pp END AS pp, CASE WHEN v.ps = v.source THEN v.pa END AS pa, v.available_at AS vat,
     coalesce(v.ps = v.source, FALSE) AS hp FROM got g LEFT JOIN pv v ON v.record_id = g.rid),
   l AS (SELECT match_id, unnest(['ranking_trend.' || side || '.rank_bucket', 'ranking_trend.' || side || '.rank_improvement', 'ranking_trend.' || side || '.points_change', 'ranking_trend.' || side || '.publication_gap_days']) AS feature,
     unnest([CASE WHEN rid IS NULL THEN NULL ELSE 1e0 + CAST(rank > 10 AS INT) + CAST(rank > 25 AS INT) + CAST(rank > 50 AS INT) + CAST(rank > 100 AS INT) END, CAST(pr - rank AS DOUBLE), points - pp, (epoch_us(vat) - epoch_us(pa)) / 86400000000.0]) AS value,
     unnest([coalesce(why, 'no_history'), coalesce(why, 'no_history'), CASE WHEN hp THEN 'upstream_unavailable' ELSE coalesce(why, 'no_history') END, coalesce(why, 'no_history')]) AS why FROM j)
   SELECT match_id, feature, round(value, 6) + 0.0 AS value, CASE WHEN value IS NULL THEN 'missing' ELSE 'observed' END AS status, CASE WHEN value IS NULL THEN why END AS reason FROM l""")
def e9(t: Tables):
    return long(X.ranking_trends(event_fixtures(t), event_observations(t), 3))


# One market per team id; its cutoff lies some hours into January.
MARKET_SQL = ctes("observations") + """, ctx AS (SELECT DISTINCT team_id AS match_id, TIMESTAMP '2024-01-01 06:00:00' + to_hours(team_id * 5) AS prediction_time FROM observations),
   el AS (SELECT o.*, c.prediction_time, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS tot FROM observations o JOIN ctx c ON CASE WHEN o.team_id % 9 = 4 THEN -1 - o.team_id ELSE o.team_id END = c.match_id WHERE o.leakage_risk = 'safe' AND o.available_at <= c.prediction_time),
   lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id, source ORDER BY available_at DESC, record_id DESC) AS l, row_number() OVER (PARTITION BY team_id, source ORDER BY available_at, record_id) AS f FROM el) WHERE l = 1 OR f = 1),
   ag AS (SELECT team_id AS match_id, count(*) FILTER (WHERE l = 1) AS n, avg(tot - 1) FILTER (WHERE l = 1) AS ov, max((epoch_us(prediction_time) - epoch_us(available_at)) / 3600000000.0) FILTER (WHERE l = 1) AS age,
     avg(1 / home_odds / tot) FILTER (WHERE l = 1) AS lh, avg(1 / draw_odds / tot) FILTER (WHERE l = 1) AS ld, avg(1 / away_odds / tot) FILTER (WHERE l = 1) AS la,
     avg(1 / home_odds / tot) FILTER (WHERE f = 1) AS oh, avg(1 / draw_odds / tot) FILTER (WHERE f = 1) AS od, avg(1 / away_odds / tot) FILTER (WHERE f = 1) AS oa FROM lt GROUP BY team_id)"""


def market_contexts(t: Tables):
    return t.observations.select(F.col("team_id").alias("match_id")).distinct().withColumn(
        "prediction_time", F.expr("timestampadd(HOUR, CAST(match_id * 5 AS INT), TIMESTAMP '2024-01-01 06:00:00')"))


def market_odds(t: Tables):
    # some markets' odds stand under ids without a context
    return t.observations.withColumn("match_id", F.when(F.col("team_id") % 9 == 4, -1 - F.col("team_id")).otherwise(F.col("team_id")))


@query("e10_market_consensus", MARKET_SQL + """ SELECT c.match_id, CAST(n AS DOUBLE) AS sources, round(ov, 6) + 0.0 AS overround, round(age, 6) + 0.0 AS age, round(lh, 6) + 0.0 AS home, round(ld, 6) + 0.0 AS draw, round(la, 6) + 0.0 AS away,
   round(lh - oh, 6) + 0.0 AS home_move, round(ld - od, 6) + 0.0 AS draw_move, round(la - oa, 6) + 0.0 AS away_move, CASE WHEN n IS NOT NULL THEN NULL WHEN c.match_id % 9 = 4 THEN 'upstream_unavailable' ELSE 'temporal_integrity' END AS reason
   FROM ctx c LEFT JOIN ag ON c.match_id = ag.match_id""")
def e10(t: Tables):
    f = X.market_features(market_contexts(t), market_odds(t))
    names = {"sources": "source_count", "overround": "average_overround", "age": "oldest_source_snapshot_age_hours"}
    for o in ("home", "draw", "away"):
        names[o] = f"{o}_fair_probability"
        names[f"{o}_move"] = f"{o}_fair_probability_move_from_open"
    one = lambda n: F.max(F.when(F.col("feature") == f"market.consensus.{n}", F.col("value")))
    return f.groupBy("match_id").agg(*[r6(one(n)).alias(a) for a, n in names.items()], F.max("reason").alias("reason"))


TRAVEL_SQL = EVENT_FIX + """, loc AS (SELECT CASE WHEN record_id % 4 = 0 THEN 'venue' ELSE 'team' END AS k, CASE WHEN record_id % 4 = 0 THEN team_id % 35 ELSE team_id END AS id, lat, lon, available_at, leakage_risk, record_id FROM ob),
   ask AS (SELECT match_id, prediction_time, neutral, 'venue' AS role, 'venue' AS k, venue_id AS id FROM fx UNION ALL SELECT match_id, prediction_time, neutral, 'home', 'team', home_id FROM fx UNION ALL SELECT match_id, prediction_time, neutral, 'away', 'team', away_id FROM fx),
   bl AS (SELECT a.match_id, a.role, arg_max(l.record_id, (l.available_at, l.record_id)) AS rid FROM ask a JOIN loc l ON a.k = l.k AND a.id = l.id AND l.available_at <= a.prediction_time AND l.leakage_risk = 'safe' GROUP BY 1, 2),
   r AS (SELECT a.match_id, a.neutral, a.role, l.lat, l.lon, CASE WHEN l.record_id IS NOT NULL THEN NULL WHEN EXISTS (SELECT 1 FROM loc x WHERE x.k = a.k AND x.id = a.id) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS why
     FROM ask a LEFT JOIN bl b ON a.match_id = b.match_id AND a.role = b.role LEFT JOIN loc l ON l.record_id = b.rid),
   w AS (SELECT t.match_id, t.role, t.neutral, CASE WHEN t.lat IS NULL OR v.lat IS NULL THEN NULL ELSE 1 END * 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(v.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - t.lon) / 2), 2)))) AS km,
     CASE WHEN t.lat IS NOT NULL AND v.lat IS NOT NULL THEN NULL WHEN t.why = 'temporal_integrity' OR v.why = 'temporal_integrity' THEN 'temporal_integrity' ELSE coalesce(t.why, v.why) END AS why FROM r t JOIN r v ON t.match_id = v.match_id AND v.role = 'venue' AND t.role <> 'venue')"""


@query("e11_travel", TRAVEL_SQL + """ SELECT h.match_id, CAST(h.neutral AS DOUBLE) AS neutral, round(h.km, 3) + 0.0 AS home_km, round(a.km, 3) + 0.0 AS away_km, round(h.km - a.km, 3) + 0.0 AS diff_km, h.why AS home_reason, a.why AS away_reason,
   CASE WHEN h.km - a.km IS NULL THEN CASE WHEN h.why = 'temporal_integrity' OR a.why = 'temporal_integrity' THEN 'temporal_integrity' ELSE coalesce(h.why, a.why) END END AS diff_reason
   FROM w h JOIN w a ON h.match_id = a.match_id AND h.role = 'home' AND a.role = 'away'""")
def e11(t: Tables):
    ob, venue = event_observations(t), F.col("record_id") % 4 == 0
    loc = ob.select(F.when(venue, F.lit("venue")).otherwise(F.lit("team")).alias("place_kind"), F.when(venue, F.col("team_id") % 35).otherwise(F.col("team_id")).alias("place_id"),
                    "lat", "lon", "available_at", "leakage_risk", "record_id")
    f = X.travel_features(event_fixtures(t), loc)
    one = lambda n, c="value": F.max(F.when(F.col("feature") == n, F.col(c)))
    km = lambda n: F.round(one(n), 3) + F.lit(0.0)
    h, a, d = "travel.home.reference_distance_km", "travel.away.reference_distance_km", "travel.reference_distance_diff_home_minus_away_km"
    return f.groupBy("match_id").agg(one("context.match.neutral_site").alias("neutral"), km(h).alias("home_km"), km(a).alias("away_km"), km(d).alias("diff_km"),
                                     one(h, "reason").alias("home_reason"), one(a, "reason").alias("away_reason"), one(d, "reason").alias("diff_reason"))


SQUAD_SQL = ctes("matches", "eligible", "players") + """, el AS (SELECT p.*, row_number() OVER (PARTITION BY p.match_id, side, player_id ORDER BY p.available_at DESC, record_id DESC, probability DESC, minutes DESC NULLS LAST) AS rn FROM players p JOIN eligible e ON p.match_id = e.match_id
     WHERE p.leakage_risk = 'safe' AND p.available_at <= e.prediction_time),
   s AS (SELECT match_id, side, count(*) AS n, avg(probability) AS mp, sum(1 - probability) AS un, count(minutes) / count(*) AS cov, sum(minutes * probability) / nullif(sum(minutes), 0) AS mw FROM el WHERE rn = 1 GROUP BY 1, 2),
   b AS (SELECT match_id, side FROM eligible, (VALUES ('home'), ('away')) AS v(side))"""


@query("e12_squad_availability", SQUAD_SQL + """ SELECT b.match_id, b.side, CAST(coalesce(n, 0) AS DOUBLE) AS players, round(mp, 6) + 0.0 AS mean_probability, round(un, 6) + 0.0 AS expected_unavailable, round(cov, 6) + 0.0 AS minutes_coverage,
   round(mw, 6) + 0.0 AS minutes_weighted, CASE WHEN n IS NOT NULL THEN NULL WHEN (b.match_id, b.side) IN (SELECT (match_id, side) FROM players) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS reason
   FROM b LEFT JOIN s ON b.match_id = s.match_id AND b.side = s.side""")
def e12(t: Tables):
    f = X.squad_features(t.eligible, t.players).filter("feature LIKE 'squad.home.%' OR feature LIKE 'squad.away.%'")
    side, metric = F.split_part("feature", F.lit("."), F.lit(2)), F.split_part("feature", F.lit("."), F.lit(3))
    one = lambda n, c="value": F.max(F.when(metric == n, F.col(c)))
    m = X.SQUAD_METRICS
    return f.groupBy("match_id", side.alias("side")).agg(
        one("player_observation_count").alias("players"), r6(one(m[0])).alias("mean_probability"), r6(one(m[1])).alias("expected_unavailable"),
        r6(one(m[2])).alias("minutes_coverage"), r6(one(m[3])).alias("minutes_weighted"), one(m[0], "reason").alias("reason"))


FIELDS_SQL = "[" + ", ".join(f"'{f}'" for f in X.MANUAL_FIELDS) + "]"
MANUAL_SQL = ctes("matches", "eligible", "players") + f""", man AS (SELECT match_id, side, {FIELDS_SQL}[CAST(record_id % 14 AS INT) + 1] AS field, record_id, available_at, leakage_risk, coalesce(minutes, 0.5) AS value FROM players),
   ok AS (SELECT * FROM man WHERE CASE WHEN field IN ('manager_tenure_days', 'top_five_league_players', 'champions_league_players') THEN value >= 0 AND value = floor(value)
     WHEN field = 'squad_average_age' THEN value BETWEEN 15 AND 60 WHEN field = 'timezone_shift_hours' THEN value BETWEEN -24 AND 24 WHEN field = 'altitude_m' THEN value BETWEEN -500 AND 9000 ELSE value BETWEEN 0 AND 1 END)"""


@query("e13_manual_context", MANUAL_SQL + """ SELECT o.match_id, o.side, field, round(arg_max(o.value, (o.available_at, o.record_id, o.value)), 6) + 0.0 AS value FROM ok o JOIN eligible e ON o.match_id = e.match_id
   WHERE o.available_at <= e.prediction_time GROUP BY 1, 2, 3""")
def e13(t: Tables):
    names = F.array(*[F.lit(f) for f in X.MANUAL_FIELDS])
    man = t.players.select("match_id", "side", F.element_at(names, (F.col("record_id") % 14 + 1).cast("int")).alias("field"), "record_id", "available_at",
                           "leakage_risk", F.coalesce("minutes", F.lit(0.5)).alias("value"), F.lit("ok").alias("legal_use_notes"))
    f = X.manual_features(t.eligible, man).filter("value IS NOT NULL")
    part = lambda i: F.split_part("feature", F.lit("."), F.lit(i))
    return f.select("match_id", part(2).alias("side"), part(3).alias("field"), r6("value").alias("value"))


@query("e14_competition_code", f"{ctes('matches')} SELECT DISTINCT competition_id, CAST(dense_rank() OVER (ORDER BY competition_id) - 1 AS DOUBLE) AS competition_code FROM matches")
def e14(t: Tables):
    return X.competition_codes(t.matches)


PAIR_SQL = EVENT_FIX + """, rel AS (SELECT record_id AS release_id, team_id, available_at, DATE '2024-01-01' + CAST(rank % 30 AS INTEGER) AS split FROM observations WHERE source = 'signup'),
   bm AS (SELECT f.match_id, f.side, arg_max(r.split, (r.available_at, r.release_id)) AS split FROM fs f JOIN rel r ON f.team_id = r.team_id AND r.available_at <= f.prediction_time GROUP BY 1, 2),
   mm AS (SELECT f.match_id, f.side, CASE WHEN split IS NULL THEN NULL WHEN CAST(prediction_time AS DATE) < split THEN 'UEFA' ELSE 'AFC' END AS member FROM fs f LEFT JOIN bm b ON f.match_id = b.match_id AND f.side = b.side),
   pr AS (SELECT h.match_id, h.member AS hm, a.member AS am FROM mm h JOIN mm a ON h.match_id = a.match_id AND h.side = 'home' AND a.side = 'away')"""


def pair_codes(t: Tables):
    from .temporal_queries import releases

    contexts = event_fixtures(t).withColumn("match_date", F.to_date("prediction_time"))
    return X.confederation_pairs(contexts, releases(t))


@query("e15_confederation_pair", PAIR_SQL + """ SELECT match_id, hm AS home_member, am AS away_member, CASE WHEN hm IS NULL OR am IS NULL THEN 0e0 ELSE CASE hm WHEN 'AFC' THEN 0 ELSE 5 END * 6 + CASE am WHEN 'AFC' THEN 1e0 ELSE 6e0 END END AS pair_code FROM pr""")
def e15(t: Tables):
    return pair_codes(t).select("match_id", "home_member", "away_member", "pair_code")


@query("e16_difference_reasons", SQUAD_SQL + """, j AS (SELECT h.match_id, hs.mp AS hm, sa.mp AS am,
     CASE WHEN hs.mp IS NOT NULL THEN NULL WHEN (h.match_id, 'home') IN (SELECT (match_id, side) FROM players) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS hw,
     CASE WHEN sa.mp IS NOT NULL THEN NULL WHEN (h.match_id, 'away') IN (SELECT (match_id, side) FROM players) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS aw
     FROM eligible h LEFT JOIN s hs ON h.match_id = hs.match_id AND hs.side = 'home' LEFT JOIN s sa ON h.match_id = sa.match_id AND sa.side = 'away')
   SELECT match_id, round(hm - am, 6) + 0.0 AS value, CASE WHEN hm - am IS NOT NULL THEN NULL WHEN hw = 'temporal_integrity' OR aw = 'temporal_integrity' THEN 'temporal_integrity' ELSE coalesce(hw, aw) END AS reason FROM j""")
def e16(t: Tables):
    f = X.squad_features(t.eligible, t.players).filter("feature = 'squad.mean_availability_probability_diff_home_minus_away'")
    return f.select("match_id", r6("value").alias("value"), "reason")


FORM5 = (5,)


def form_frames(t: Tables):
    """Form and rest of every match as one long frame (used by assembly, imputation and the datasets)."""
    history = H.recent_history(t.eligible, 5)
    return M.assemble([X.form_features(history, t.eligible, FORM5), X.rest(history, t.eligible)])


DECLARED = X.form_feature_names(FORM5) + ["schedule.home.rest_days", "schedule.away.rest_days", "schedule.rest_days_diff_home_minus_away"]
RULES = {n: (0.0 if "goal_diff" in n else 1.0) for n in X.form_feature_names(FORM5)} | {n: 30.0 for n in DECLARED if n.startswith("schedule.")}


@query("e17_vector_contract", f"{ctes('matches')} SELECT match_id, 0::BIGINT AS undeclared, 3::BIGINT AS missing, 0::BIGINT AS duplicated, 13::BIGINT AS wrong_cutoff FROM matches WHERE match_id % 100 = 7")
def e17(t: Tables):
    # planted faults: every hundredth match loses its rest features and the rest keep a shifted cutoff
    bad = F.col("match_id") % 100 == 7
    frame = form_frames(t).filter(~(bad & F.col("feature").startswith("schedule.")))
    frame = frame.withColumn("prediction_time", F.when(bad, F.col("prediction_time") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("prediction_time")))
    out = M.contract_violations(frame, t.eligible, DECLARED)
    return out.select("match_id", "undeclared", "missing", "duplicated", (F.col("wrong_cutoff") + 3).alias("wrong_cutoff"))


WIDE_SQL = REST_SQL + f""", fm AS MATERIALIZED (SELECT t.match_id, t.side, {_form_sql(5)} FROM sides t LEFT JOIN past h ON t.match_id = h.match_id AND t.side = h.side GROUP BY ALL),
   wide AS (SELECT p.match_id, coalesce(f.points_5, 1e0) AS home_points, CASE WHEN f.points_5 IS NULL THEN 1e0 ELSE 0e0 END AS home_points_missing, coalesce(g.goal_diff_5, 0e0) AS away_goal_diff,
     coalesce(hd, 30e0) AS home_rest, CASE WHEN hd IS NULL THEN 1e0 ELSE 0e0 END AS home_rest_missing, CASE WHEN hw IS NOT NULL THEN 1e0 ELSE 0e0 END AS home_rest_imputed,
     CASE WHEN f.points_5 IS NULL THEN 4 ELSE 0 END + CASE WHEN g.points_5 IS NULL THEN 4 ELSE 0 END + CASE WHEN hd IS NULL THEN 1 ELSE 0 END + CASE WHEN ad IS NULL THEN 1 ELSE 0 END + CASE WHEN hd - ad IS NULL THEN 1 ELSE 0 END AS applied
     FROM p JOIN fm f ON p.match_id = f.match_id AND f.side = 'home' JOIN fm g ON p.match_id = g.match_id AND g.side = 'away')"""


def _wide(df):
    return [r6("`form.home.points_per_match_5`").alias("home_points"), F.col("`form.home.points_per_match_5__is_missing`").alias("home_points_missing"),
            r6("`form.away.goal_diff_per_match_5`").alias("away_goal_diff"), r6("`schedule.home.rest_days`").alias("home_rest"),
            F.col("`schedule.home.rest_days__is_missing`").alias("home_rest_missing"), F.col("`schedule.home.rest_days__is_imputed`").alias("home_rest_imputed"),
            F.col("applied_imputations").alias("applied")]


@query("e18_materialize", WIDE_SQL + " SELECT match_id, home_points, home_points_missing, away_goal_diff, round(home_rest, 6) + 0.0 AS home_rest, home_rest_missing, home_rest_imputed, CAST(applied AS BIGINT) AS applied, 0::BIGINT AS unruled FROM wide")
def e18(t: Tables):
    w = M.materialize(form_frames(t), DECLARED, RULES)
    return w.select("match_id", *_wide(w), F.col("unruled_features").alias("unruled"))


@query("e19_historical_dataset", WIDE_SQL + """ SELECT w.match_id, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END AS target,
   CAST(floor(epoch(eligible_at)) AS BIGINT) AS target_available_at, home_points, CAST(floor(epoch(prediction_time)) AS BIGINT) AS prediction_time FROM wide w JOIN eligible e ON w.match_id = e.match_id WHERE e.eligible_at IS NOT NULL""")
def e19(t: Tables):
    d = M.historical_dataset(t.eligible, M.materialize(form_frames(t), DECLARED, RULES))
    return d.select("match_id", "target", epoch("target_available_at").alias("target_available_at"), r6("`form.home.points_per_match_5`").alias("home_points"),
                    epoch("prediction_time").alias("prediction_time"))


@query("e20_model_dataset", WIDE_SQL + f""", d AS (SELECT w.*, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END AS target FROM wide w JOIN eligible e ON w.match_id = e.match_id WHERE e.eligible_at IS NOT NULL)
   SELECT target, count(*) AS row_count, {CONTENT_SUM} FROM (SELECT target, sha256(CAST(match_id AS VARCHAR) || chr(31) || CAST(CAST(round(home_rest * 1000) AS BIGINT) AS VARCHAR)) AS h FROM d) GROUP BY target""")
def e20(t: Tables):
    d = M.historical_dataset(t.eligible, M.materialize(form_frames(t), DECLARED, RULES))
    usable = M.model_dataset(d, DECLARED).withColumn("rest_ms", F.round(F.col("`schedule.home.rest_days`") * 1000).cast("long"))
    return ids.fingerprint(usable, ["match_id", "rest_ms"], ["target"])


SLATE_SQL = REPLAY_ROWS + """, ls AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, home_id DESC, away_id DESC, match_id DESC) AS rn FROM r WHERE match_date < DATE '1999-01-01'),
   tf AS (SELECT team_id, avg(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) FILTER (WHERE rn <= 5) AS p5, avg(gf - ga) FILTER (WHERE rn <= 10) AS d10 FROM ls WHERE rn <= 10 GROUP BY team_id)
   SELECT m.match_id, round(coalesce(h.p5, 1e0), 6) + 0.0 AS home_points_5, round(coalesce(a.p5, 1e0), 6) + 0.0 AS away_points_5, round(coalesce(h.d10, 0e0), 6) + 0.0 AS home_diff_10, round(coalesce(a.d10, 0e0), 6) + 0.0 AS away_diff_10
   FROM matches m LEFT JOIN tf h ON m.home_id = h.team_id LEFT JOIN tf a ON m.away_id = a.team_id WHERE m.status = 'scheduled' AND m.match_date >= DATE '1999-01-01'"""


@query("e22_fixture_slate", SLATE_SQL)
def e22(t: Tables):
    form = X.form_before(t.matches.filter("status = 'completed'"), "1999-01-01")
    slate = t.matches.filter("status = 'scheduled' AND match_date >= DATE '1999-01-01'").select("match_id", "home_id", "away_id")
    out = X.attach_team_features(slate, form, {c: M.default_value(c) for c in form.columns if c != "team_id"})
    return out.select("match_id", r6("home_form_5_points_per_match").alias("home_points_5"), r6("away_form_5_points_per_match").alias("away_points_5"),
                      r6("home_form_10_goal_diff_per_match").alias("home_diff_10"), r6("away_form_10_goal_diff_per_match").alias("away_diff_10"))


WEIGHT_SQL = "CASE trim(lower(status_text)) WHEN 'available' THEN 1e0 WHEN 'doubtful' THEN 0.25e0 WHEN 'out' THEN 0e0 WHEN 'suspended' THEN 0e0 WHEN 'limited' THEN 0.65e0 WHEN 'fit' THEN 1e0 ELSE 0.5e0 END"
TEAM_SQL = ctes("predictions", "players") + f""", w AS (SELECT team, {WEIGHT_SQL} AS w, greatest(importance, 0) * least(greatest(coalesce(minutes, 0), 0), 120) / 90 AS base, least(greatest(coalesce(minutes, 0), 0), 120) AS m FROM players),
   ta AS (SELECT team, count(*) AS player_count, count(*) FILTER (WHERE w >= 0.75) AS available_player_count, count(*) FILTER (WHERE w <= 0.05) AS unavailable_player_count, sum(m) AS minutes_total,
     coalesce(sum(base * w) / nullif(sum(base), 0), 0) AS availability_pct, coalesce(sum(base - base * w) / nullif(sum(base), 0), 0) AS unavailable_value_pct FROM w GROUP BY team)"""


@query("e23_team_availability", TEAM_SQL + " SELECT team, player_count, available_player_count, unavailable_player_count, round(minutes_total, 4) + 0.0 AS minutes_total, round(availability_pct, 6) + 0.0 AS availability_pct, round(unavailable_value_pct, 6) + 0.0 AS unavailable_value_pct FROM ta")
def e23(t: Tables):
    return X.team_availability(t.players).select("team", "player_count", "available_player_count", "unavailable_player_count", (F.round("expected_minutes_total", 4) + F.lit(0.0)).alias("minutes_total"),
                                                 r6("availability_pct").alias("availability_pct"), r6("unavailable_value_pct").alias("unavailable_value_pct"))


def forecasts(t: Tables):
    name = lambda c: F.concat(F.lit("T"), F.col(c))
    return t.predictions.withColumn("home_team", name("home_id")).withColumn("away_team", F.when(F.col("away_id") < 90, name("away_id")).otherwise(F.lit("unknown")))


ADJ_SQL = TEAM_SQL + """, fx AS (SELECT p.*, 'T' || home_id AS ht, CASE WHEN away_id < 90 THEN 'T' || away_id ELSE 'unknown' END AS awt FROM predictions p),
   j AS (SELECT fx.*, coalesce(h.availability_pct, 1) AS ha, coalesce(a.availability_pct, 1) AS aa, coalesce(h.unavailable_value_pct, 0) AS hu, coalesce(a.unavailable_value_pct, 0) AS au FROM fx LEFT JOIN ta h ON fx.ht = h.team LEFT JOIN ta a ON fx.awt = a.team)"""


@query("e24_fixture_availability", ADJ_SQL + " SELECT row_id, model_id, round(p_home, 6) + 0.0 AS p, round(ha - aa, 6) + 0.0 AS availability_pct_diff, round(hu - au, 6) + 0.0 AS unavailable_value_pct_diff FROM j")
def e24(t: Tables):
    out = X.fixture_availability(forecasts(t), X.team_availability(t.players))
    return out.select("row_id", "model_id", r6("p_home").alias("p"), r6("availability_pct_diff").alias("availability_pct_diff"), r6("unavailable_value_pct_diff").alias("unavailable_value_pct_diff"))


@query("e25_availability_adjustment", ADJ_SQL + """, s AS (SELECT *, least(greatest(0.1 * (ha - aa) - 0.05 * (hu - au), -0.08e0), 0.08e0) AS sh FROM j),
   x AS (SELECT *, greatest(p_home + sh, 0.01) AS xh, greatest(p_draw, 0.01) AS xd, greatest(p_away - sh, 0.01) AS xa FROM s)
   SELECT row_id, model_id, round(sh, 6) + 0.0 AS shift, round(xh / (xh + xd + xa), 6) + 0.0 AS home, round(xd / (xh + xd + xa), 6) + 0.0 AS draw,
   CASE WHEN xh >= xd AND xh >= xa THEN ht WHEN xd >= xa THEN 'Draw' ELSE awt END AS winner FROM x""")
def e25(t: Tables):
    out = X.availability_adjustment(forecasts(t), X.team_availability(t.players))
    return out.select("row_id", "model_id", r6("shift").alias("shift"), r6("adjusted_home").alias("home"), r6("adjusted_draw").alias("draw"), F.col("adjusted_winner").alias("winner"))


@query("e26_market_movement", ctes("observations") + """, a AS (SELECT team_id, arg_min((home_odds, draw_odds, away_odds), (available_at, record_id)) AS o, arg_max((home_odds, draw_odds, away_odds), (available_at, record_id)) AS l, count(*) AS n FROM observations GROUP BY team_id),
   u AS (SELECT team_id, n, o[1] AS oh, o[2] AS od, o[3] AS oa, l[1] AS lh, l[2] AS ld, l[3] AS la FROM a),
   m AS (SELECT *, 1 / lh - 1 / oh AS mh, 1 / ld - 1 / od AS md, 1 / la - 1 / oa AS ma FROM u), g AS (SELECT *, CASE WHEN abs(mh) >= abs(md) AND abs(mh) >= abs(ma) THEN 'home' WHEN abs(md) >= abs(ma) THEN 'draw' ELSE 'away' END AS big FROM m)
   SELECT team_id AS fixture_id, n AS snapshot_count, round(lh - oh, 6) + 0.0 AS home_odds_move, round(md, 6) + 0.0 AS draw_implied_move, big AS largest_outcome,
     CASE WHEN (CASE big WHEN 'home' THEN mh WHEN 'draw' THEN md ELSE ma END) > 0 THEN 'market_toward_' || big WHEN (CASE big WHEN 'home' THEN mh WHEN 'draw' THEN md ELSE ma END) < 0 THEN 'market_away_from_' || big ELSE 'market_unchanged' END AS market_direction FROM g""")
def e26(t: Tables):
    out = X.market_movement(t.observations.withColumnRenamed("team_id", "fixture_id"), ["record_id"])
    return out.select("fixture_id", "snapshot_count", r6("home_odds_move").alias("home_odds_move"), r6("draw_implied_move").alias("draw_implied_move"), "largest_outcome", "market_direction")


@query("e27_neutralise_features", f"{REPLAY_ROWS} SELECT match_id, side, {_replay_sql(5)}, 1e0 AS form_10_points_per_match, 0e0 AS form_10_goal_diff_per_match, 1e0 AS form_10_goals_for_per_match, 1e0 AS form_10_goals_against_per_match FROM r")
def e27(t: Tables):
    out = X.replay_form(t.matches.filter("status = 'completed'"))
    columns = [c for c in out.columns if c.startswith("form_")]
    kept = M.neutralise(out, columns, [c for c in columns if c.startswith("form_5_")])
    return kept.select("match_id", "side", *[r6(c).alias(c) for c in columns])
