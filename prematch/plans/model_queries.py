"""Ratings (F*) and models (G*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions.common import r6
from ..operators import baselines as B
from ..operators import boosted_trees
from ..operators import classifiers as C
from ..operators import opponent as O
from ..operators import ratings as R
from ..operators import transforms as X
from .bindings import Tables, ctes
from .evaluation_queries import PRED
from .feature_queries import PAIR_SQL, REPLAY_ROWS, _replay_sql, pair_codes
from .registry import query

M = ctes("matches")
DONE = "status = 'completed'"


# One recursion step per match; the state is the list of all team ratings (team ids are 0..96).
WEIGHT = "CASE tournament WHEN 'FIFA World Cup' THEN 1.6e0 WHEN 'FIFA World Cup qualification' THEN 1.25e0 WHEN 'UEFA Euro' THEN 1.15e0 WHEN 'Friendly' THEN 0.75e0 ELSE 1e0 END"


def elo_sql(order: str) -> str:
    """WITH clause ending in elo(match_id, hb, ab, ch, ex): a sequential replay in plain SQL."""
    return M.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS n, match_id, home_id + 1 AS h, away_id + 1 AS a, home_score AS hs, away_score AS aws,
     CASE WHEN neutral THEN 0e0 ELSE 75e0 END AS adv, {WEIGHT} AS w FROM matches WHERE {DONE}),
   e(n, match_id, hb, ab, ch, ex, r) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0e0, 0e0, 0e0, 0e0, list_transform(range(97), lambda x: 1500e0)
     UNION ALL SELECT n, match_id, hb, ab, ch, ex, list_transform(r, lambda x, i: CASE WHEN i = h THEN x + ch WHEN i = a THEN x - ch ELSE x END) FROM (
       SELECT n, match_id, h, a, r, rh AS hb, ra AS ab, ex, 20 * w * CASE WHEN abs(hs - aws) <= 1 THEN 1e0 ELSE ln(abs(hs - aws) + 1) * 2.2e0 / (0.001e0 * abs(rh + adv - ra) + 2.2e0) END
         * (CASE WHEN hs > aws THEN 1e0 WHEN hs = aws THEN 0.5e0 ELSE 0e0 END - ex) AS ch
       FROM (SELECT o.*, e.r, e.r[o.h] AS rh, e.r[o.a] AS ra, 1 / (1 + pow(10, (e.r[o.a] - e.r[o.h] - o.adv) / 400)) AS ex FROM e JOIN o ON o.n = e.n + 1))),
   elo AS (SELECT match_id, hb, ab, ch, ex, n FROM e WHERE n > 0)"""


BY_DATE = elo_sql("match_date, home_id, away_id, match_id")


@query("f1_elo_replay", BY_DATE + " SELECT match_id, round(hb, 6) + 0.0 AS home_before, round(ab, 6) + 0.0 AS away_before, round(hb + ch, 6) + 0.0 AS home_after, round(ab - ch, 6) + 0.0 AS away_after, round(ex, 6) + 0.0 AS expected_home, round(ch, 6) + 0.0 AS rating_change FROM elo")
def f1(t: Tables):
    h = R.elo_history(t.matches.filter(DONE))
    return h.select("match_id", *[r6(c).alias(c) for c in ("home_before", "away_before", "home_after", "away_after", "expected_home", "rating_change")])


@query("f1_elo_final_ratings", BY_DATE + """, s AS (SELECT m.home_id AS team_id, n, hb + ch AS rating FROM elo JOIN matches m ON m.match_id = elo.match_id UNION ALL SELECT m.away_id, n, ab - ch FROM elo JOIN matches m ON m.match_id = elo.match_id)
   SELECT team_id, count(*) AS matches, round(arg_max(rating, n), 6) + 0.0 AS rating FROM s GROUP BY team_id""")
def f1_final(t: Tables):
    return R.elo_final(R.elo_history(t.matches.filter(DONE))).select("team_id", "matches", r6("rating").alias("rating"))


@query("f2_elo_kickoff_order", elo_sql("match_date, kickoff_at IS NULL, kickoff_at, home_id, away_id, match_id") + " SELECT match_id, round(hb, 6) + 0.0 AS home_before, round(ex, 6) + 0.0 AS expected_home, round(ch, 6) + 0.0 AS rating_change FROM elo")
def f2(t: Tables):
    h = R.elo_history(t.matches.filter(DONE), order=R.KICKOFF_ORDER)
    return h.select("match_id", r6("home_before").alias("home_before"), r6("expected_home").alias("expected_home"), r6("rating_change").alias("rating_change"))


FORM_COLUMNS = ", ".join(f"{a}.form_{n}_{m}_per_match AS {side}_form_{n}_{m}_per_match" for a, side in (("h", "home"), ("w", "away")) for n in (5, 10)
                         for m in ("points", "goal_diff", "goals_for", "goals_against"))


@query("e21_pre_match_table", BY_DATE + REPLAY_ROWS[len(M):] + f""", fm AS (SELECT match_id, side, {_replay_sql(5)}, {_replay_sql(10)} FROM r)
   SELECT m.match_id, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END AS outcome, round(hb, 6) + 0.0 AS home_elo_pre, round(ab, 6) + 0.0 AS away_elo_pre,
     round(hb - ab, 6) + 0.0 AS elo_diff_home_minus_away, round(abs(hb - ab), 6) + 0.0 AS abs_elo_diff, round(ex, 6) + 0.0 AS elo_expected_home_score, round(1 - ex, 6) + 0.0 AS elo_expected_away_score,
     CASE WHEN neutral THEN 1e0 ELSE 0e0 END AS is_neutral, CASE WHEN tournament = 'FIFA World Cup' THEN 1e0 ELSE 0e0 END AS is_world_cup, {WEIGHT} AS tournament_importance, {FORM_COLUMNS}
   FROM elo JOIN matches m ON m.match_id = elo.match_id JOIN fm h ON h.match_id = m.match_id AND h.side = 'home' JOIN fm w ON w.match_id = m.match_id AND w.side = 'away'""")
def e21(t: Tables):
    table = R.pre_match_table(t.matches.filter(DONE))
    return table.select("match_id", "outcome", *[r6(c).alias(c) for c in R.PRE_MATCH_COLUMNS])


@query("f3_ambiguous_order", f"""{M}, s AS (SELECT match_date, kickoff_at, home_id AS team_id FROM matches UNION ALL SELECT match_date, kickoff_at, away_id FROM matches)
   SELECT CAST(match_date AS VARCHAR) AS match_date, team_id, count(*) AS matches, count(*) FILTER (WHERE kickoff_at IS NULL) AS unknown_kickoffs FROM s GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE kickoff_at IS NULL) > 0""")
def f3(t: Tables):
    return R.ambiguous_order(t.matches).withColumn("match_date", F.col("match_date").cast("string"))


# One step per day played. States are lists of ratings, deviations and last days; games lists both views of every match.
Q2 = "pow(ln(10) / 400, 2)"
G = f"1 / sqrt(1 + 3 * {Q2} * pow(pd[g.p], 2) / pow(pi(), 2))"
EXP = f"1 / (1 + pow(10, -({G}) * (rr[g.o] - rr[g.p]) / 400))"
GLICKO_SQL = M.replace("WITH ", "WITH RECURSIVE ", 1) + f""", v AS (SELECT match_date AS d, home_id + 1 AS o, away_id + 1 AS p, CASE WHEN home_score > away_score THEN 1e0 WHEN home_score = away_score THEN 0.5e0 ELSE 0e0 END AS s FROM matches WHERE {DONE}
     UNION ALL SELECT match_date, away_id + 1, home_id + 1, CASE WHEN home_score > away_score THEN 0e0 WHEN home_score = away_score THEN 0.5e0 ELSE 1e0 END FROM matches WHERE {DONE}),
   dy AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d) AS n, d, list({{'o': o, 'p': p, 's': s}}) AS gm, list(DISTINCT o) AS tm FROM v GROUP BY d),
   st(n, d, tm, r0, pd, rr, dd, ll) AS (SELECT CAST(0 AS BIGINT), DATE '1900-01-01', CAST([] AS BIGINT[]), list_transform(range(97), lambda x: 1500e0), list_transform(range(97), lambda x: 350e0), list_transform(range(97), lambda x: 1500e0),
       list_transform(range(97), lambda x: 350e0), list_transform(range(97), lambda x: CAST(NULL AS DATE))
     UNION ALL SELECT n, d, tm, rr, pd, list_transform(rr, lambda x, i: CASE WHEN list_contains(tm, i) THEN x + ln(10) / 400 / (1 / pow(pd[i], 2) + inf[i]) * res[i] ELSE x END),
       list_transform(dd, lambda x, i: CASE WHEN list_contains(tm, i) THEN sqrt(1 / (1 / pow(pd[i], 2) + inf[i])) ELSE x END), list_transform(ll, lambda x, i: CASE WHEN list_contains(tm, i) THEN d ELSE x END)
     FROM (SELECT *, list_transform(range(1, 98), lambda i: coalesce(list_sum(list_transform(tr, lambda t: CASE WHEN t.o = i THEN t.a END)), 0)) AS inf, list_transform(range(1, 98), lambda i: coalesce(list_sum(list_transform(tr, lambda t: CASE WHEN t.o = i THEN t.b END)), 0)) AS res
       FROM (SELECT *, list_transform(gm, lambda g: {{'o': g.o, 'a': {Q2} * pow({G}, 2) * ({EXP}) * (1 - {EXP}), 'b': ({G}) * (g.s - {EXP})}}) AS tr
         FROM (SELECT dy.n, dy.d, dy.gm, dy.tm, st.rr, st.dd, st.ll, list_transform(st.dd, lambda x, i: CASE WHEN st.ll[i] IS NULL THEN x ELSE least(350, sqrt(x * x + 2500 * date_diff('day', st.ll[i], dy.d) / 30e0)) END) AS pd FROM st JOIN dy ON dy.n = st.n + 1)))),
   gl AS (SELECT d, unnest(tm) AS t, r0, pd, rr, dd FROM st WHERE n > 0)"""


@query("f4_glicko_replay", GLICKO_SQL + " SELECT t - 1 AS team_id, CAST(d AS VARCHAR) AS effective_date, round(r0[t], 6) + 0.0 AS rating_before, round(pd[t], 6) + 0.0 AS deviation_before, round(rr[t], 6) + 0.0 AS rating, round(dd[t], 6) + 0.0 AS deviation FROM gl")
def f4(t: Tables):
    g = R.glicko_history(t.matches.filter(DONE))
    return g.select("team_id", F.col("effective_date").cast("string").alias("effective_date"), *[r6(c).alias(c) for c in ("rating_before", "deviation_before", "rating", "deviation")])


# Any dated state table will do for the interval read, so the check needs no replay.
@query("f5_current_ratings", f"""{M}, s AS (SELECT home_id AS team_id, match_date, match_id, 1400e0 + home_score * 20 AS rating, 60e0 + away_score * 30 AS deviation FROM matches WHERE {DONE} AND match_date <= DATE '2000-06-30'),
   l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn FROM s) WHERE rn = 1), i AS (SELECT team_id, rating, least(350, sqrt(deviation * deviation + 2500 * date_diff('day', match_date, DATE '2000-06-30') / 30)) AS dev FROM l)
   SELECT team_id, round(rating, 6) + 0.0 AS rating, round(dev, 6) + 0.0 AS deviation, round(rating - 1.96 * dev, 6) + 0.0 AS lower, round(rating + 1.96 * dev, 6) + 0.0 AS upper FROM i""")
def f5(t: Tables):
    from ..operators.asof import latest_per

    states = t.matches.filter(DONE).select(F.col("home_id").alias("team_id"), F.col("match_date").alias("effective_date"), "match_id",
                                           (1400.0 + F.col("home_score") * 20).alias("rating"), (60.0 + F.col("away_score") * 30).alias("deviation"))
    daily = latest_per(states, ["team_id", "effective_date"], ["match_id"])
    return R.current_ratings(daily, "2000-06-30").select("team_id", *[r6(c).alias(c) for c in ("rating", "deviation", "lower", "upper")])


@query("f5_rating_movers", f"""{M} SELECT match_id AS team_id, CAST(home_score * 100 - away_score * 130 AS DOUBLE) AS rating_change FROM matches WHERE {DONE} ORDER BY abs(home_score * 100 - away_score * 130) DESC, match_id""")
def f5_movers(t: Tables):
    rows = t.matches.filter(DONE).select(F.col("match_id").alias("team_id"), (F.col("home_score") * 100 - F.col("away_score") * 130).cast("double").alias("rating_change"))
    return R.movers(rows)


LABEL = "CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END"
TRAIN_SQL = f"{M}, tr AS (SELECT *, {LABEL} AS target FROM matches WHERE {DONE} AND match_date < DATE '2000-01-01')"


def train(t: Tables):
    return t.matches.filter(f"{DONE} AND match_date < DATE '2000-01-01'").withColumn("target", P.outcome_label("home_score", "away_score"))


SHARES = "(count(*) FILTER (WHERE target = 'home_win') + {s}{h}) / (count(*) + {m}) AS p_home, (count(*) FILTER (WHERE target = 'draw') + {s}{d}) / (count(*) + {m}) AS p_draw, (count(*) FILTER (WHERE target = 'away_win') + {s}{a}) / (count(*) + {m}) AS p_away"
GLOBAL_SQL = "g AS (SELECT " + SHARES.format(s="1e0", h="", d="", a="", m="3") + " FROM tr)"
GROUP_SHARES = SHARES.format(s="10 * ", h="max(g.p_home)", d="max(g.p_draw)", a="max(g.p_away)", m="10")


def shares(df, *keep):
    return df.select(*keep, *[r6(f"p_{s}").alias(f"p_{s}") for s in ("home", "draw", "away")])


ROUND3 = "round(p_home, 6) + 0.0 AS p_home, round(p_draw, 6) + 0.0 AS p_draw, round(p_away, 6) + 0.0 AS p_away"


@query("g1_class_frequency", f"{TRAIN_SQL}, {GLOBAL_SQL} SELECT {ROUND3} FROM g")
def g1(t: Tables):
    return shares(B.class_frequency(train(t)))


@query("g2_competition_frequency", f"""{TRAIN_SQL}, {GLOBAL_SQL}, gr AS (SELECT competition_id, {GROUP_SHARES} FROM tr, g WHERE competition_id <> '5-LOW' GROUP BY competition_id),
   s AS (SELECT m.match_id, coalesce(gr.p_home, g.p_home) AS p_home, coalesce(gr.p_draw, g.p_draw) AS p_draw, coalesce(gr.p_away, g.p_away) AS p_away FROM g, matches m LEFT JOIN gr ON m.competition_id = gr.competition_id WHERE match_date >= DATE '2000-01-01')
   SELECT match_id, {ROUND3} FROM s""")
def g2(t: Tables):
    tr = train(t)
    base = B.class_frequency(tr)
    fitted = B.group_frequency(tr, "competition_id", global_only=F.col("competition_id") == "5-LOW")
    rows = t.matches.filter("match_date >= DATE '2000-01-01'").select("match_id", "competition_id")
    return shares(B.score_groups(rows, fitted, base, "competition_id"), "match_id")


@query("g3_confederation_frequency", f"""{PAIR_SQL}, cd AS (SELECT match_id, CASE WHEN hm IS NULL OR am IS NULL THEN 0e0 ELSE CASE hm WHEN 'AFC' THEN 0 ELSE 5 END * 6 + CASE am WHEN 'AFC' THEN 1e0 ELSE 6e0 END END AS pair_code,
     CASE match_id % 4 WHEN 0 THEN 'draw' WHEN 1 THEN 'away_win' ELSE 'home_win' END AS target FROM pr), tr AS (SELECT * FROM cd), {GLOBAL_SQL}, gr AS (SELECT pair_code, {GROUP_SHARES} FROM tr, g WHERE pair_code <> 0 GROUP BY pair_code)
   SELECT match_id, round(coalesce(gr.p_home, g.p_home), 6) + 0.0 AS p_home, round(coalesce(gr.p_draw, g.p_draw), 6) + 0.0 AS p_draw, round(coalesce(gr.p_away, g.p_away), 6) + 0.0 AS p_away FROM g, cd LEFT JOIN gr ON cd.pair_code = gr.pair_code""")
def g3(t: Tables):
    codes = pair_codes(t)
    target = F.when(F.col("match_id") % 4 == 0, F.lit("draw")).when(F.col("match_id") % 4 == 1, F.lit("away_win")).otherwise(F.lit("home_win"))
    rows = codes.select("match_id", "pair_code", target.alias("target"))
    fitted = B.group_frequency(rows, "pair_code", global_only=F.col("pair_code") == 0)
    return shares(B.score_groups(rows, fitted, B.class_frequency(rows), "pair_code"), "match_id")


GOALS_SQL = f"""{TRAIN_SQL}, ts AS (SELECT home_id AS team_id, home_score AS gf, away_score AS ga FROM tr UNION ALL SELECT away_id, away_score, home_score FROM tr), gl AS (SELECT avg(gf) AS g FROM ts),
   st AS (SELECT team_id, count(*) AS matches, avg(gf) / max(g) AS attack, avg(ga) / max(g) AS defence, max(g) AS g FROM ts, gl GROUP BY team_id)"""
XG_SQL = GOALS_SQL + f""", fx AS (SELECT match_id, CASE WHEN match_id % 50 = 0 THEN -1 ELSE home_id END AS home_id, away_id, neutral FROM matches WHERE match_date >= DATE '2000-01-01'),
   xg AS (SELECT f.match_id, least(greatest(gl.g * h.attack * a.defence * CASE WHEN neutral THEN 1 ELSE 1.1e0 END, 0.2e0), 5e0) AS lh, least(greatest(gl.g * a.attack * h.defence / CASE WHEN neutral THEN 1 ELSE 1.1e0 END, 0.2e0), 5e0) AS la, h.team_id IS NULL AS bad
     FROM gl, fx f LEFT JOIN st h ON f.home_id = h.team_id LEFT JOIN st a ON f.away_id = a.team_id)"""


def fixtures(t: Tables):
    rows = t.matches.filter("match_date >= DATE '2000-01-01'")
    return rows.select("match_id", F.when(F.col("match_id") % 50 == 0, F.lit(-1)).otherwise(F.col("home_id")).alias("home_id"), "away_id", "neutral")


def rated(t: Tables):
    return B.expected_goals(fixtures(t), B.fit_poisson(train(t)))


@query("g4_poisson_fit", GOALS_SQL + " SELECT team_id, matches, round(attack, 6) + 0.0 AS attack, round(defence, 6) + 0.0 AS defence, round(g, 6) + 0.0 AS global_rate FROM st")
def g4(t: Tables):
    return B.fit_poisson(train(t)).select("team_id", "matches", *[r6(c).alias(c) for c in ("attack", "defence", "global_rate")])


@query("g5_expected_goals", XG_SQL + " SELECT match_id, round(CASE WHEN NOT bad THEN lh END, 6) + 0.0 AS home_rate, round(CASE WHEN NOT bad THEN la END, 6) + 0.0 AS away_rate, CASE WHEN bad THEN 'no_goal_history' END AS rejected FROM xg")
def g5(t: Tables):
    return rated(t).select("match_id", r6("home_rate").alias("home_rate"), r6("away_rate").alias("away_rate"), "rejected")


@query("g6_score_grid", XG_SQL + """, cl AS (SELECT x.match_id, i.i, j.j, exp(-lh) * pow(lh, i) / factorial(CAST(i AS INTEGER)) * exp(-la) * pow(la, j) / factorial(CAST(j AS INTEGER)) AS w FROM (SELECT * FROM xg WHERE NOT bad) x, range(11) i(i), range(11) j(j)),
   s AS (SELECT match_id, sum(w) AS kept, sum(w) FILTER (WHERE i > j) / sum(w) AS p_home, sum(w) FILTER (WHERE i = j) / sum(w) AS p_draw, sum(w) FILTER (WHERE i < j) / sum(w) AS p_away, arg_max([i, j], (round(w, 12), -i, -j)) AS mode, max(w) AS mw FROM cl GROUP BY match_id)
   SELECT match_id, round(p_home, 6) + 0.0 AS p_home, round(p_draw, 6) + 0.0 AS p_draw, round(p_away, 6) + 0.0 AS p_away, CAST(mode[1] AS INTEGER) AS mode_home, CAST(mode[2] AS INTEGER) AS mode_away, round(mw / kept, 6) + 0.0 AS mode_probability,
     round(-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)), 6) + 0.0 AS entropy, round(greatest(0, 1 - kept), 6) + 0.0 AS omitted_tail FROM s""")
def g6(t: Tables):
    g = B.score_grid(rated(t).filter("rejected IS NULL"))
    return g.select("match_id", "mode_home", "mode_away", *[r6(c).alias(c) for c in ("p_home", "p_draw", "p_away", "mode_probability", "entropy", "omitted_tail")])


@query("g7_opponent_poisson")
def g7(t: Tables):
    teams, scalars = O.fit_opponent_poisson(train(t))
    return teams.select("team", r6("attack").alias("attack"), r6("defence").alias("defence"), F.round(F.lit(scalars["base"]), 6).alias("base"), F.round(F.lit(scalars["home"]), 6).alias("home"))


# Every coefficient of the fitted goal model must be where its own slope is 0.
@query("g7_opponent_slopes", f"""{M}, tr AS (SELECT * FROM matches WHERE {DONE} AND match_date < DATE '2000-01-01'), t AS (SELECT home_id AS t FROM tr UNION SELECT away_id FROM tr)
   SELECT 'base' AS coefficient, 0e0 AS slope UNION ALL SELECT 'home', 0e0 UNION ALL SELECT 'attack:' || t, 0e0 FROM t UNION ALL SELECT 'defence:' || t, 0e0 FROM t""")
def g7_slopes(t: Tables):
    teams, scalars = O.fit_opponent_poisson(train(t))
    return O.goal_model_slopes(train(t), teams, scalars).select("coefficient", (F.round("slope", 5) + F.lit(0.0)).alias("slope"))


# Two separated leagues: a visitor from the other league plays under a number of its own (from 1000 on), so teams below and from 48 on never meet.
@query("g8_opponent_components", f"{M}, e AS (SELECT home_id AS a, CASE WHEN (home_id < 48) = (away_id < 48) THEN away_id ELSE away_id + 1000 END AS b FROM matches), n AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, CASE WHEN node < 48 OR node >= 1048 THEN (SELECT min(node) FROM n) ELSE (SELECT min(node) FROM n WHERE node >= 48 AND node < 1048) END AS component FROM n")
def g8(t: Tables):
    visitor = F.when((F.col("home_id") < 48) == (F.col("away_id") < 48), F.col("away_id")).otherwise(F.col("away_id") + 1000)
    return O.opponent_components(t.matches.withColumn("away_id", visitor))


def pre_match(t: Tables):
    """Training table of the fitted classifiers, written once so that every optimiser pass reads a table."""
    from ..session import spread, stored

    done = t.matches.filter(DONE)
    return stored(spread(R.pre_match_table(done), done.count()))


def _split(t: Tables):
    from ..operators.evaluation import date_split

    table = date_split(pre_match(t), "match_date", "2000-01-01")
    return table.filter("role = 'train'"), table.filter("role = 'test'")


@query("g9_logistic_regression")
def g9(t: Tables):
    tr, te = _split(t)
    weighted = C.recency_weights(tr, "match_date", C.TUNED_HALF_LIFE)
    model = C.fit_logistic(weighted, R.PRE_MATCH_COLUMNS, "outcome", C.TUNED_LOGISTIC_C, "weight")
    return shares(C.score(model, te), "match_id")


@query("g10_boosted_trees")
def g10(t: Tables):
    tr, te = _split(t)
    return shares(C.fit_boosting(tr, R.PRE_MATCH_COLUMNS, "outcome").score(te), "match_id")


# Gains of every split that the first trees may start with. At the start all rows of a class have one probability, so sums of gradients follow from counts.
FIRST_FEATURES = ["home_id", "away_id", "day", "hour", "neutral"]


@query("g10_first_gains", f"""{M}, r AS (SELECT CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score = away_score THEN 'draw' ELSE 'away_win' END AS target, CAST(home_id AS DOUBLE) AS home_id, CAST(away_id AS DOUBLE) AS away_id,
     CAST(date_diff('day', DATE '1970-01-01', match_date) AS DOUBLE) AS day, CAST(hour(kickoff_at) AS DOUBLE) AS hour, CASE WHEN neutral THEN 1e0 ELSE 0e0 END AS neutral FROM matches WHERE {DONE}),
   x AS ({" UNION ALL ".join(f"SELECT target, '{f}' AS feature, {f} AS v FROM r" for f in FIRST_FEATURES)}),
   c AS (SELECT feature, v, count(*) FILTER (WHERE target = 'home_win') AS home_win, count(*) FILTER (WHERE target = 'draw') AS draw, count(*) FILTER (WHERE target = 'away_win') AS away_win FROM x GROUP BY feature, v),
   e AS (SELECT DISTINCT feature, unnest(quantile_cont(v, [{", ".join(f"{i}e0 / 64" for i in range(1, 64))}])) AS threshold FROM x GROUP BY feature),
   l AS (SELECT e.feature, e.threshold, sum(home_win) AS home_win, sum(draw) AS draw, sum(away_win) AS away_win FROM e JOIN c ON c.feature = e.feature AND (c.v IS NULL OR c.v <= e.threshold) GROUP BY e.feature, e.threshold),
   k AS (SELECT feature, threshold, home_win + draw + away_win AS n_left, unnest(['home_win', 'draw', 'away_win']) AS outcome, unnest([home_win, draw, away_win]) AS y_left FROM l),
   w AS (SELECT target AS outcome, count(*) AS y, (SELECT count(*) FROM r) AS n FROM r GROUP BY target),
   u AS (SELECT outcome, y, n, round((1e0 * y / n) * 1048576) / 1048576 AS zero, round((1e0 * y / n - 1) * 1048576) / 1048576 AS one, round((1e0 * y / n) * (1 - 1e0 * y / n) * 1048576) / 1048576 AS h FROM w),
   g AS (SELECT k.outcome, feature, threshold, n_left, n, h * n_left + 0.05e0 AS hl, h * (n - n_left) + 0.05e0 AS hr, h * n + 0.05e0 AS ht, one * y_left + zero * (n_left - y_left) AS gl, one * y + zero * (n - y) AS gt FROM k JOIN u ON u.outcome = k.outcome)
   SELECT outcome, feature, round(threshold, 6) + 0.0 AS threshold, CAST(n_left AS BIGINT) AS n_left, round(gl * gl / hl + (gt - gl) * (gt - gl) / hr - gt * gt / ht, 6) + 0.0 AS gain FROM g WHERE n_left >= 20 AND n - n_left >= 20""")
def g10_gains(t: Tables):
    rows = t.matches.filter(DONE).select(P.outcome_label("home_score", "away_score").alias("target"), "home_id", "away_id", F.unix_date("match_date").alias("day"), F.hour("kickoff_at").alias("hour"), F.col("neutral").cast("int").alias("neutral"))
    out = boosted_trees.first_gains(rows, FIRST_FEATURES, "target")
    return out.select("outcome", "feature", F.round("threshold", 6).alias("threshold"), "n_left", (F.round("gain", 6) + F.lit(0.0)).alias("gain"))


@query("g11_random_forest")
def g11(t: Tables):
    tr, te = _split(t)
    return shares(C.score(C.fit_forest(tr, R.PRE_MATCH_COLUMNS, "outcome", numTrees=20, maxDepth=6), te), "match_id")


@query("g12_batch_scoring")
def g12(t: Tables):
    tr, te = _split(t)
    model = C.fit_logistic(tr, R.PRE_MATCH_COLUMNS, "outcome")
    out = C.score_logistic_expression(model, te, R.PRE_MATCH_COLUMNS)
    return shares(out, "match_id", P.argmax_outcome(*P.triple()).alias("predicted"), r6(F.greatest(*P.triple())).alias("confidence"))


GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]


@query("g13_temperature_grid", PRED + ", t AS (SELECT unnest([" + ", ".join(f"{x}e0" for x in GRID) + """]) AS temperature), s AS (SELECT temperature, actual, pow(p_home, 1 / temperature) AS h, pow(p_draw, 1 / temperature) AS d, pow(p_away, 1 / temperature) AS a FROM predictions, t)
   SELECT temperature, round(avg(-ln(CASE actual WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END / (h + d + a))), 6) + 0.0 AS log_loss FROM s GROUP BY temperature""")
def g13(t: Tables):
    return X.temperature_table(t.predictions, GRID).select("temperature", r6("log_loss").alias("log_loss"))


@query("g13_temperature_fit")
def g13_fit(t: Tables):
    temperature = X.fit_temperature(t.predictions)
    out = X.apply_temperature(t.predictions, temperature)
    return out.agg(F.lit(temperature).alias("temperature"), F.avg(P.log_loss("actual", *P.triple())).alias("before"), F.avg(P.log_loss("actual", *P.triple("c_"))).alias("after"))


@query("g14_ensemble_grid", PRED + """, w AS (SELECT i / 10e0 AS w0, j / 10e0 AS w1, (10 - i - j) / 10e0 AS w2 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10),
   s AS (SELECT CASE actual WHEN 'home_win' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END AS p, CASE actual WHEN 'home_win' THEN q_home WHEN 'draw' THEN q_draw ELSE q_away END AS q FROM predictions)
   SELECT w0, w1, w2, round(avg(-ln(greatest(w0 * p + w1 * q + w2 / 3, 1e-12))) + 0.01 * (pow(w0 - 1 / 3e0, 2) + pow(w1 - 1 / 3e0, 2) + pow(w2 - 1 / 3e0, 2)), 6) + 0.0 AS loss FROM s, w GROUP BY w0, w1, w2""")
def g14(t: Tables):
    third = F.lit(1.0) / 3
    rows = t.predictions.withColumns({"u_home": third, "u_draw": third, "u_away": third})
    return X.ensemble_table(rows, ["p_", "q_", "u_"]).select("w0", "w1", "w2", r6("loss").alias("loss"))


@query("g14_ensemble_fit")
def g14_fit(t: Tables):
    weights = X.fit_ensemble(t.predictions, ["p_", "q_"])
    out = X.apply_ensemble(t.predictions, ["p_", "q_"], weights)
    return out.agg(F.lit(weights[0]).alias("w0"), F.lit(weights[1]).alias("w1"), F.avg(P.log_loss("actual", *P.triple("e_"))).alias("log_loss"))


@query("g15_held_out_audit", f"""{ctes("predictions")}, m AS (SELECT model_id AS member, TIMESTAMP '1995-03-01 00:00:00' AS f FROM predictions GROUP BY 1), c AS (SELECT match_id, count(*) AS n FROM predictions GROUP BY 1),
   v AS (SELECT p.row_id, concat_ws(',', CASE WHEN prediction_time >= TIMESTAMP '2001-01-01 00:00:00' OR prediction_time + INTERVAL 2 DAY > TIMESTAMP '2001-01-01 00:00:00' THEN 'not_settled_before_fit' END,
     CASE WHEN prediction_time < TIMESTAMP '1995-03-01 00:00:00' THEN 'member_newer_than_row' END, CASE WHEN p.match_id % 200 = 5 THEN 'row_in_member_training' END, CASE WHEN c.n > 1 THEN 'repeated_match' END) AS codes FROM predictions p JOIN c ON p.match_id = c.match_id)
   SELECT codes, count(*) AS n FROM v WHERE codes <> '' GROUP BY codes""")
def g15(t: Tables):
    p = t.predictions
    members = p.select(F.col("model_id").alias("member"), F.lit("1995-03-01").cast("timestamp").alias("member_fitted_at")).distinct()
    trained = p.filter("match_id % 200 = 5").select("model_id", "match_id")
    held = p.withColumn("target_available_at", F.col("prediction_time") + F.expr("INTERVAL 2 DAY"))
    bad = X.held_out_violations(held, "2001-01-01", members, trained)
    return bad.groupBy(F.concat_ws(",", "violations").alias("codes")).agg(F.count("*").alias("n"))


@query("g15_sample_requirements", f"{PRED} SELECT count(*) AS n, count(*) FILTER (WHERE actual = 'home_win') AS home_win, '' AS problems FROM predictions")
def g15_sample(t: Tables):
    return X.sample_requirements(t.predictions, "actual", 30).select("n", "home_win", F.concat_ws(",", "problems").alias("problems"))


@query("g16_fixed_blend", PRED + """, b AS (SELECT *, (p_home + q_home) / 2 AS h, (p_draw + q_draw) / 2 AS d, (p_away + q_away) / 2 AS a FROM predictions)
   SELECT row_id, model_id, round(h, 6) + 0.0 AS e_home, round(-(h * ln(h) + d * ln(d) + a * ln(a)) / ln(3), 6) + 0.0 AS entropy, round(greatest(abs(p_home - q_home), abs(p_draw - q_draw), abs(p_away - q_away)), 6) + 0.0 AS disagreement,
   CASE WHEN greatest(h, d, a) >= 0.6 AND -(h * ln(h) + d * ln(d) + a * ln(a)) / ln(3) <= 0.75 THEN 'High' WHEN greatest(h, d, a) >= 0.45 THEN 'Medium' ELSE 'Low' END AS confidence FROM b""")
def g16(t: Tables):
    out = B.combine_members(t.predictions)
    return out.select("row_id", "model_id", r6("e_home").alias("e_home"), r6("ensemble_entropy").alias("entropy"), r6("max_model_disagreement").alias("disagreement"), F.col("ensemble_confidence").alias("confidence"))


@query("g17_logistic_contributions")
def g17(t: Tables):
    tr, te = _split(t)
    model = C.fit_logistic(tr, R.PRE_MATCH_COLUMNS, "outcome")
    out = C.score_logistic_expression(model, te, R.PRE_MATCH_COLUMNS).withColumn("predicted", P.argmax_outcome(*P.triple()))
    return C.top_contributions(model, out, R.PRE_MATCH_COLUMNS, "predicted").select("match_id", "predicted", "rank", "feature", r6("contribution").alias("contribution"))
