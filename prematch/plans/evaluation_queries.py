"""Scoring, folds, comparison, slices, drift and benchmarks (H*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.common import r6
from ..operators import evaluation as V
from .bindings import Tables, ctes
from .feature_queries import DECLARED, PAIR_SQL, event_fixtures
from .registry import query
from .temporal_queries import releases

PRED = ctes("predictions")
SCORED = ctes("predictions", "scored")


def row_metrics(prefix: str) -> str:
    h, d, a = (f"{prefix}{x}" for x in ("home", "draw", "away"))
    hit = {o: f"CASE WHEN actual = '{o}' THEN 1 ELSE 0 END" for o in ("home_win", "draw", "away_win")}
    pick = f"CASE actual WHEN 'home_win' THEN {h} WHEN 'draw' THEN {d} ELSE {a} END"
    best = f"CASE WHEN {h} >= {d} AND {h} >= {a} THEN 'home_win' WHEN {d} >= {a} THEN 'draw' ELSE 'away_win' END"
    return (f"CASE WHEN {best} = actual THEN 1e0 ELSE 0e0 END AS accuracy, -ln(least(1, greatest({pick}, 1e-15))) AS log_loss, "
            f"pow({h} - {hit['home_win']}, 2) + pow({d} - {hit['draw']}, 2) + pow({a} - {hit['away_win']}, 2) AS brier, "
            f"(pow({h} - {hit['home_win']}, 2) + pow({a} - {hit['away_win']}, 2)) / 2 AS rps")


AVG = ", ".join(f"round(avg({m}), 6) + 0.0 AS {m}" for m in V.METRICS)


def rounded(df, *keep):
    return df.select(*keep, *[r6(m).alias(m) for m in V.METRICS])


@query("h1_metrics", f"{PRED}, r AS (SELECT model_id, {row_metrics('p_')} FROM predictions) SELECT model_id, count(*) AS n, {AVG} FROM r GROUP BY model_id")
def h1(t: Tables):
    return rounded(V.metrics(t.predictions, ["model_id"]), "model_id", "n")


CAL_SQL = PRED + """, l AS (SELECT model_id, 'home_win' AS outcome, p_home AS p, actual FROM predictions UNION ALL SELECT model_id, 'draw', p_draw, actual FROM predictions UNION ALL SELECT model_id, 'away_win', p_away, actual FROM predictions),
   b AS (SELECT model_id, outcome, {0} AS bin, count(*) AS n, sum(p) AS sp, sum(CASE WHEN actual = outcome THEN 1 ELSE 0 END) AS sy FROM l GROUP BY 1, 2, 3),
   g AS (SELECT m.model_id, o.outcome, i.bin FROM (SELECT DISTINCT model_id FROM predictions) m, (SELECT DISTINCT outcome FROM l) o, (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) i),
   bins AS (SELECT g.model_id, g.outcome, g.bin, coalesce(n, 0) AS count, sp / n AS mean_forecast, sy / n AS observed, sy / n - sp / n AS error FROM g LEFT JOIN b ON g.model_id = b.model_id AND g.outcome = b.outcome AND g.bin = b.bin)"""
BIN_LEFT = "CAST(least(floor(p * 10), 9) AS INTEGER)"
BINS_OUT = " SELECT model_id, outcome, bin, count, round(mean_forecast, 6) + 0.0 AS mean_forecast, round(observed, 6) + 0.0 AS observed, round(error, 6) + 0.0 AS error FROM bins"


def _bins(df):
    return df.select("model_id", "outcome", "bin", "count", *[r6(c).alias(c) for c in ("mean_forecast", "observed", "error")])


@query("h2_calibration_bins", CAL_SQL.format(BIN_LEFT) + BINS_OUT)
def h2(t: Tables):
    return _bins(V.calibration_bins(t.predictions, 10, ["model_id"]))


@query("h2_calibration_bins_right_closed", CAL_SQL.format("CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER)") + BINS_OUT)
def h2_right(t: Tables):
    return _bins(V.calibration_bins(t.predictions, 10, ["model_id"], "right"))


@query("h2_calibration_summary", CAL_SQL.format(BIN_LEFT) + """, s AS (SELECT model_id, outcome, sum(count * abs(error)) / sum(count) AS ece, max(abs(error)) AS max_error, sum(count * error) / sum(count) AS bias FROM bins GROUP BY 1, 2)
   SELECT model_id, outcome, round(ece, 6) + 0.0 AS ece, round(max_error, 6) + 0.0 AS max_error, round(bias, 6) + 0.0 AS bias, round(avg(ece) OVER (PARTITION BY model_id), 6) + 0.0 AS macro_ece FROM s""")
def h2_summary(t: Tables):
    s = V.calibration_summary(V.calibration_bins(t.predictions, 10, ["model_id"]), ["model_id"])
    return s.select("model_id", "outcome", *[r6(c).alias(c) for c in ("ece", "max_error", "bias", "macro_ece")])


CUTOFFS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01", "2010-01-01"]
ELIG = ctes("matches", "eligible")


def fold_sql(training_days: int | None) -> str:
    start = f"prediction_time >= cutoff - INTERVAL {training_days} DAY" if training_days else "TRUE"
    values = ", ".join(f"(TIMESTAMP '{c} 00:00:00', '{c}')" for c in CUTOFFS)
    return f"""folds(cutoff, fold_id) AS (VALUES {values}), ex AS (SELECT match_id, prediction_time, eligible_at, home_score, away_score, competition_id FROM eligible WHERE eligible_at IS NOT NULL),
      asg AS (SELECT * FROM (SELECT f.fold_id, f.cutoff, e.*, CASE WHEN prediction_time < cutoff AND {start} AND eligible_at <= cutoff THEN 'train' WHEN prediction_time < cutoff AND {start} THEN 'waiting'
        WHEN prediction_time >= cutoff AND prediction_time < cutoff + INTERVAL 90 DAY THEN 'test' END AS role FROM ex e, folds f) WHERE role IS NOT NULL)"""


def examples(t: Tables):
    return t.eligible.filter("eligible_at IS NOT NULL").select(
        "match_id", "prediction_time", F.col("eligible_at").alias("target_available_at"), "home_score", "away_score", "competition_id")


@query("h3_expanding_folds", f"{ELIG}, {fold_sql(None)} SELECT fold_id, match_id, role FROM asg")
def h3(t: Tables):
    return V.assign_folds(examples(t), V.fold_table(CUTOFFS, 90)).select("fold_id", "match_id", "role")


@query("h3_rolling_folds", f"{ELIG}, {fold_sql(400)} SELECT fold_id, match_id, role FROM asg")
def h3_rolling(t: Tables):
    return V.assign_folds(examples(t), V.fold_table(CUTOFFS, 90, 400)).select("fold_id", "match_id", "role")


@query("h4_fold_report", f"""{ELIG}, {fold_sql(400)}, c AS (SELECT f.fold_id, count(*) FILTER (WHERE role = 'train') AS train_count, count(*) FILTER (WHERE role = 'test') AS test_count, count(*) FILTER (WHERE role = 'waiting') AS unavailable_targets
     FROM folds f LEFT JOIN asg a ON f.fold_id = a.fold_id GROUP BY f.fold_id)
   SELECT *, CASE WHEN train_count < 1600 AND train_count + unavailable_targets >= 1600 AND unavailable_targets > 0 THEN 'insufficient_available_targets' WHEN train_count < 1600 THEN 'insufficient_training_examples'
     WHEN test_count = 0 THEN 'empty_evaluation_window' END AS skip_reason FROM c""")
def h4(t: Tables):
    return V.fold_report(examples(t), V.fold_table(CUTOFFS, 90, 400), 1600)


# A tampered assignment: some waiting rows are passed off as training rows and some training rows repeat as test rows.
@query("h5_fold_leakage_audit", f"""{ELIG}, {fold_sql(None)}, tam AS (SELECT fold_id, cutoff, match_id, prediction_time, eligible_at, CASE WHEN role = 'waiting' THEN 'train' ELSE role END AS role FROM asg
     UNION ALL SELECT fold_id, cutoff, match_id, prediction_time, eligible_at, 'test' FROM asg WHERE role = 'train' AND match_id % 500 = 0),
   r AS (SELECT fold_id, match_id, count(DISTINCT role) AS roles FROM tam GROUP BY 1, 2),
   v AS (SELECT t.fold_id, t.match_id, t.role, concat_ws(',', CASE WHEN roles > 1 THEN 'in_train_and_test' END, CASE WHEN t.role = 'train' AND eligible_at > cutoff THEN 'target_unavailable' END,
     CASE WHEN t.role = 'test' AND prediction_time < cutoff THEN 'test_before_cutoff' END) AS violations FROM tam t JOIN r ON t.fold_id = r.fold_id AND t.match_id = r.match_id)
   SELECT * FROM v WHERE violations <> ''""")
def h5(t: Tables):
    a = V.assign_folds(examples(t), V.fold_table(CUTOFFS, 90))
    tampered = a.withColumn("role", F.when(F.col("role") == "waiting", F.lit("train")).otherwise(F.col("role"))).unionByName(
        a.filter("role = 'train' AND match_id % 500 = 0").withColumn("role", F.lit("test")))
    return V.fold_leaks(tampered).select("fold_id", "match_id", "role", F.concat_ws(",", "violations").alias("violations"))


@query("h6_chronological_split", f"""{ctes("matches")}, o AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS n FROM matches)
   SELECT match_id, CASE WHEN rn <= CAST(floor(n * 0.7e0) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM o""")
def h6(t: Tables):
    return V.chronological_split(t.matches, "match_date", "match_id", 0.3).select("match_id", "role")


@query("h6_date_split", f"{ctes('matches')} SELECT match_id, CASE WHEN match_date < DATE '1999-03-05' THEN 'train' ELSE 'test' END AS role FROM matches")
def h6_date(t: Tables):
    return V.date_split(t.matches, "match_date", "1999-03-05").select("match_id", "role")


FREQ_SQL = """tr AS (SELECT fold_id, count(*) AS n, count(*) FILTER (WHERE home_score > away_score) AS h, count(*) FILTER (WHERE home_score = away_score) AS d, count(*) FILTER (WHERE home_score < away_score) AS a FROM asg WHERE role = 'train' GROUP BY fold_id),
   pr AS (SELECT s.fold_id, s.match_id, (h + 1) / (n + 3) AS p_home, (d + 1) / (n + 3) AS p_draw, (a + 1) / (n + 3) AS p_away, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END AS actual
     FROM asg s JOIN tr ON s.fold_id = tr.fold_id AND s.role = 'test')"""


@query("h7_backtest_frequency", f"{ELIG}, {fold_sql(None)}, {FREQ_SQL}, r AS (SELECT fold_id, {row_metrics('p_')} FROM pr) SELECT fold_id, count(*) AS n, {AVG} FROM r GROUP BY fold_id")
def h7(t: Tables):
    from ..operators import backtest as B

    return rounded(V.metrics(B.frequency_backtest(examples(t), V.fold_table(CUTOFFS, 90)), ["fold_id"]), "fold_id", "n")


# Independent Poisson fitted per fold and scored on the fold's test matches.
POISSON_BT_SQL = """ts AS (SELECT s.fold_id, m.home_id AS team, s.home_score AS gf, s.away_score AS ga FROM asg s JOIN matches m ON s.match_id = m.match_id WHERE role = 'train' UNION ALL
     SELECT s.fold_id, m.away_id, s.away_score, s.home_score FROM asg s JOIN matches m ON s.match_id = m.match_id WHERE role = 'train'),
   gl AS (SELECT fold_id, avg(gf) AS g FROM ts GROUP BY fold_id), st AS (SELECT t.fold_id, team, avg(gf) / max(g) AS att, avg(ga) / max(g) AS dfn FROM ts t JOIN gl ON t.fold_id = gl.fold_id GROUP BY 1, 2),
   xg AS (SELECT s.fold_id, s.match_id, least(greatest(g * h.att * a.dfn * CASE WHEN m.neutral THEN 1 ELSE 1.1 END, 0.2), 5) AS lh, least(greatest(g * a.att * h.dfn / CASE WHEN m.neutral THEN 1 ELSE 1.1 END, 0.2), 5) AS la, s.home_score, s.away_score
     FROM asg s JOIN matches m ON s.match_id = m.match_id JOIN gl ON gl.fold_id = s.fold_id JOIN st h ON h.fold_id = s.fold_id AND h.team = m.home_id JOIN st a ON a.fold_id = s.fold_id AND a.team = m.away_id WHERE role = 'test'),
   cl AS (SELECT x.*, i.i, j.j, exp(-lh) * pow(lh, i) / factorial(CAST(i AS INTEGER)) * exp(-la) * pow(la, j) / factorial(CAST(j AS INTEGER)) AS w FROM xg x, range(11) i(i), range(11) j(j)),
   pr AS (SELECT fold_id, match_id, sum(w) FILTER (WHERE i > j) / sum(w) AS p_home, sum(w) FILTER (WHERE i = j) / sum(w) AS p_draw, sum(w) FILTER (WHERE i < j) / sum(w) AS p_away,
     CASE WHEN max(home_score) > max(away_score) THEN 'home_win' WHEN max(home_score) < max(away_score) THEN 'away_win' ELSE 'draw' END AS actual FROM cl GROUP BY 1, 2)"""


@query("h7_backtest_poisson", f"{ELIG}, {fold_sql(None)}, {POISSON_BT_SQL}, r AS (SELECT fold_id, {row_metrics('p_')} FROM pr) SELECT fold_id, count(*) AS n, {AVG} FROM r GROUP BY fold_id")
def h7_poisson(t: Tables):
    from ..operators import backtest as B

    ex = examples(t).join(t.matches.select("match_id", "home_id", "away_id", "neutral"), "match_id")
    return rounded(V.metrics(B.poisson_backtest(ex, V.fold_table(CUTOFFS, 90)), ["fold_id"]), "fold_id", "n")


@query("h8_rolling_summary", f"""{PRED}, r AS (SELECT model_id, year(prediction_time) AS fold, {row_metrics('p_')} FROM predictions), f AS (SELECT model_id, fold, count(*) AS n, avg(accuracy) AS accuracy, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(rps) AS rps FROM r GROUP BY 1, 2)
   SELECT model_id, count(*) AS folds, CAST(sum(n) AS BIGINT) AS test_rows, round(avg(accuracy), 6) + 0.0 AS mean_accuracy, round(avg(log_loss), 6) + 0.0 AS mean_log_loss, round(avg(brier), 6) + 0.0 AS mean_brier, round(avg(rps), 6) + 0.0 AS mean_rps FROM f GROUP BY model_id""")
def h8(t: Tables):
    by_fold = V.metrics(t.predictions.withColumn("fold", F.year("prediction_time")), ["model_id", "fold"])
    s = V.summarise_backtests(by_fold, "model_id")
    return s.select("model_id", "folds", "test_rows", *[r6(f"mean_{m}").alias(f"mean_{m}") for m in V.METRICS])


def runs(t: Tables, drop: bool):
    base = t.scored.select("row_id", "model_id", "prediction_time", "actual", "p_home", "p_draw", "p_away", "q_home", "q_draw", "q_away")
    key = F.concat_ws(":", "row_id", "model_id").alias("sample")
    a = base.select(key, "prediction_time", "actual", "p_home", "p_draw", "p_away", F.lit("base").alias("run"))
    b = base.select(key, "prediction_time", "actual", F.col("q_home").alias("p_home"), F.col("q_draw").alias("p_draw"), F.col("q_away").alias("p_away"), F.lit("challenger").alias("run"))
    if drop:
        b = base.filter("row_id % 101 <> 0").select(
            key, F.when(F.col("row_id") % 103 == 0, F.col("prediction_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("prediction_time")).alias("prediction_time"), "actual",
            F.col("q_home").alias("p_home"), F.col("q_draw").alias("p_draw"), F.col("q_away").alias("p_away"), F.lit("challenger").alias("run"))
    return a.unionByName(b)


DELTA = ", ".join(f"round(avg({m}) - max(b_{m}), 6) + 0.0 AS {m}_delta" for m in ("log_loss", "brier", "rps"))


@query("h11_paired_comparison", f"""{SCORED}, r AS (SELECT 'base' AS run, {row_metrics('p_')} FROM scored UNION ALL SELECT 'challenger', {row_metrics('q_')} FROM scored),
   b AS (SELECT avg(log_loss) AS b_log_loss, avg(brier) AS b_brier, avg(rps) AS b_rps FROM r WHERE run = 'base') SELECT run, count(*) AS n, {AVG}, {DELTA} FROM r, b GROUP BY run""")
def h11(t: Tables):
    c = V.compare_runs(runs(t, False), "run", "base")
    return rounded(c, "run", "n", *[r6(f"{m}_delta").alias(f"{m}_delta") for m in ("log_loss", "brier", "rps")])


@query("h11_unpaired_samples", f"{SCORED} SELECT row_id || ':' || model_id AS sample, CASE WHEN row_id % 101 = 0 THEN 'missing_in_a_run' ELSE 'identity_differs' END AS problem FROM scored WHERE row_id % 101 = 0 OR row_id % 103 = 0")
def h11_unpaired(t: Tables):
    return V.unpaired(runs(t, True), "run", "sample", ["prediction_time", "actual"]).select("sample", F.concat_ws(",", "problems").alias("problem"))


@query("h12_block_sums", f"""{PRED}, r AS (SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(prediction_time AS DATE)) / 30) AS BIGINT) AS block, x.log_loss AS a, y.log_loss AS b, x.brier AS ab, y.brier AS bb FROM
     (SELECT *, row_number() OVER () AS i FROM predictions) p, LATERAL (SELECT {row_metrics('p.p_').replace('actual', 'p.actual')}) x, LATERAL (SELECT {row_metrics('p.q_').replace('actual', 'p.actual')}) y)
   SELECT block, count(*) AS n, round(sum(b - a), 6) + 0.0 AS log_loss, round(sum(bb - ab), 6) + 0.0 AS brier FROM r GROUP BY block""")
def h12(t: Tables):
    return V.block_sums(t.predictions).select("block", "n", r6("log_loss").alias("log_loss"), r6("brier").alias("brier"))


@query("h12_block_bootstrap")
def h12_bootstrap(t: Tables):
    out = V.block_bootstrap(V.block_sums(t.predictions))
    return out.select("metric", "blocks", "status", *[r6(c).alias(c) for c in ("delta", "lower", "upper")])


BENCH = ctes("matches", "eligible", "forecasts", "quotes") + """, pd AS (SELECT f.*, e.prediction_time, e.kickoff_at, CASE WHEN home_score > away_score THEN 'home_win' WHEN home_score < away_score THEN 'away_win' ELSE 'draw' END AS actual
     FROM forecasts f JOIN eligible e ON f.match_id = e.match_id WHERE e.eligible_at IS NOT NULL),
   q AS (SELECT * FROM quotes WHERE leakage_risk = 'safe')"""


def bench_inputs(t: Tables):
    from ..functions.probability import outcome_label

    done = t.eligible.filter("eligible_at IS NOT NULL").select("match_id", "prediction_time", "kickoff_at", outcome_label("home_score", "away_score").alias("actual"))
    return t.view("forecasts").join(done, "match_id"), t.view("quotes").filter("leakage_risk = 'safe'")


def chosen_sql(timing: str) -> str:
    order = "available_at, record_id" if timing == "opening" else "available_at DESC, record_id DESC"
    cut = "prediction_time" if timing == "prediction_time" else "kickoff_at"
    return f"""SELECT *, 1 / home_odds + 1 / draw_odds + 1 / away_odds AS tot FROM (SELECT q.*, row_number() OVER (PARTITION BY q.match_id, bookmaker ORDER BY {order}) AS rn
      FROM q JOIN pd ON q.match_id = pd.match_id AND q.available_at <= pd.{cut}) WHERE rn = 1"""


def bench_sql(timing: str) -> str:
    no_kick = "FALSE" if timing == "prediction_time" else "kickoff_at IS NULL"
    return f"""{BENCH}, ch AS ({chosen_sql(timing)}), cs AS (SELECT match_id, count(*) AS bookmakers, avg(1 / home_odds / tot) AS h, avg(1 / draw_odds / tot) AS d, avg(1 / away_odds / tot) AS a FROM ch GROUP BY match_id)
      SELECT pd.match_id, CASE WHEN {no_kick} THEN 'unknown_exact_kickoff' WHEN bookmakers IS NULL THEN 'no_eligible_market_snapshot' END AS excluded_reason, bookmakers,
        round(CASE WHEN {no_kick} OR bookmakers IS NULL THEN NULL ELSE -ln(CASE actual WHEN 'home_win' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END) END, 6) + 0.0 AS model_log_loss,
        round(CASE WHEN {no_kick} OR bookmakers IS NULL THEN NULL ELSE -ln(CASE actual WHEN 'home_win' THEN h WHEN 'draw' THEN d ELSE a END) END, 6) + 0.0 AS market_log_loss FROM pd LEFT JOIN cs ON pd.match_id = cs.match_id"""


def _benchmark(t: Tables, timing: str):
    p, q = bench_inputs(t)
    return V.market_benchmark(p, q, timing).select("match_id", "excluded_reason", "bookmakers", r6("model_log_loss").alias("model_log_loss"), r6("market_log_loss").alias("market_log_loss"))


@query("h13_market_benchmark", bench_sql("prediction_time"))
def h13(t: Tables):
    return _benchmark(t, "prediction_time")


@query("h13_market_benchmark_closing", bench_sql("closing"))
def h13_closing(t: Tables):
    return _benchmark(t, "closing")


@query("h13_market_benchmark_summary", f"""SELECT count(*) AS total_predictions, count(*) FILTER (WHERE excluded_reason IS NULL) AS matched_predictions, round(avg(CASE WHEN excluded_reason IS NULL THEN 1e0 ELSE 0e0 END), 6) + 0.0 AS coverage,
   round(avg(model_log_loss - market_log_loss), 4) + 0.0 AS delta FROM ({bench_sql("opening")}) AS x""")
def h13_summary(t: Tables):
    p, q = bench_inputs(t)
    s = V.benchmark_summary(V.market_benchmark(p, q, "opening"))
    return s.select("total_predictions", "matched_predictions", r6("coverage").alias("coverage"), (F.round("mean_log_loss_delta_vs_market", 4) + F.lit(0.0)).alias("delta"))


@query("h14_opening_vs_closing", f"""{BENCH}, op AS ({chosen_sql("opening")}), cl AS ({chosen_sql("closing")}) SELECT coalesce(o.match_id, c.match_id) AS match_id, coalesce(o.bookmaker, c.bookmaker) AS bookmaker, 'paired' AS pairing,
   o.available_at <> c.available_at AS distinct_publications, round(1 / c.home_odds / c.tot - 1 / o.home_odds / o.tot, 6) + 0.0 AS home_change FROM op o FULL JOIN cl c ON o.match_id = c.match_id AND o.bookmaker = c.bookmaker""")
def h14(t: Tables):
    p, q = bench_inputs(t)
    out = V.timing_comparison(V.market_quotes(p, q, "opening"), V.market_quotes(p, q, "closing"))
    return out.select("match_id", "bookmaker", "pairing", "distinct_publications", r6("home_change").alias("home_change"))


# Planted faults: unknown match ids, flipped targets, cutoffs after the prediction.
DIAG_SQL = BENCH + """, dx AS (SELECT CASE WHEN match_id % 97 = 3 THEN match_id + 10000000 ELSE match_id END AS match_id, p_home, p_draw, p_away, prediction_time, CASE WHEN match_id % 50 = 0 THEN 'draw' ELSE actual END AS actual,
     CASE WHEN match_id % 29 = 0 THEN prediction_time + INTERVAL 1 DAY ELSE TIMESTAMP '1994-01-01 00:00:00' END AS cutoff FROM pd),
   dg AS (SELECT d.*, e.competition_id, e.match_date, e.neutral, e.home_id, e.away_id, concat_ws(',', CASE WHEN e.match_id IS NULL THEN 'missing_match' END,
     CASE WHEN (CASE WHEN e.home_score > e.away_score THEN 'home_win' WHEN e.home_score < e.away_score THEN 'away_win' WHEN e.home_score = e.away_score THEN 'draw' END) <> actual THEN 'target_conflict' END,
     CASE WHEN d.prediction_time < cutoff THEN 'prediction_before_cutoff' END) AS violations FROM dx d LEFT JOIN eligible e ON d.match_id = e.match_id)"""


def diagnosed(t: Tables):
    p, _ = bench_inputs(t)
    m = F.col("match_id")
    p = p.withColumn("actual", F.when(m % 50 == 0, F.lit("draw")).otherwise(F.col("actual"))).withColumn(
        "cutoff", F.when(m % 29 == 0, F.col("prediction_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.lit("1994-01-01").cast("timestamp")))
    p = p.withColumn("match_id", F.when(m % 97 == 3, m + 10000000).otherwise(m)).drop("kickoff_at")
    return V.diagnostics(p, t.eligible)


@query("h15_match_diagnostics", f"{DIAG_SQL}, mx AS (SELECT match_id, violations, {row_metrics('p_')}, -(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) AS entropy FROM dg) SELECT match_id, violations, accuracy, round(log_loss, 6) + 0.0 AS log_loss, round(brier, 6) + 0.0 AS brier, round(rps, 6) + 0.0 AS rps, round(entropy, 6) + 0.0 AS entropy FROM mx")
def h15(t: Tables):
    return rounded(diagnosed(t), "match_id", F.concat_ws(",", "violations").alias("violations"), r6("entropy").alias("entropy"))


@query("h16_diagnostic_slices", f"""{DIAG_SQL}, mx AS (SELECT competition_id, match_date, neutral, home_id, away_id, actual, {row_metrics('p_')} FROM dg WHERE violations = ''),
   sl AS (SELECT 'competition' AS dimension, competition_id AS key, * FROM mx UNION ALL SELECT 'year', strftime(match_date, '%Y'), * FROM mx UNION ALL SELECT 'venue', CASE WHEN neutral THEN 'neutral' ELSE 'home' END, * FROM mx
     UNION ALL SELECT 'team', CAST(home_id AS VARCHAR), * FROM mx UNION ALL SELECT 'team', CAST(away_id AS VARCHAR), * FROM mx)
   SELECT dimension, key, count(*) AS n, {AVG}, count(*) FILTER (WHERE actual = 'draw') AS draw_count, count(*) < 200 AS below_minimum FROM sl GROUP BY dimension, key""")
def h16(t: Tables):
    clean = diagnosed(t).filter(F.size("violations") == 0)
    return rounded(V.slices(clean, V.standard_dimensions(), 200), "dimension", "key", "n", "draw_count", "below_minimum")


@query("h17_confederation_slices", f"""{PAIR_SQL}, pq AS (SELECT p.match_id, coalesce(hm, 'unknown') AS hm, coalesce(am, 'unknown') AS am, CASE p.match_id % 3 WHEN 0 THEN 'home_win' WHEN 1 THEN 'draw' ELSE 'away_win' END AS actual,
     (1 + p.match_id % 7) / (3e0 + p.match_id % 7 + p.match_id % 5 + p.match_id % 4) AS p_home, (1 + p.match_id % 5) / (3e0 + p.match_id % 7 + p.match_id % 5 + p.match_id % 4) AS p_draw, (1 + p.match_id % 4) / (3e0 + p.match_id % 7 + p.match_id % 5 + p.match_id % 4) AS p_away FROM pr p),
   mx AS (SELECT hm, am, {row_metrics('p_')} FROM pq), sl AS (SELECT 'home_confederation' AS dimension, hm AS key, * FROM mx UNION ALL SELECT 'away_confederation', am, * FROM mx UNION ALL SELECT 'confederation_pair', hm || '/' || am, * FROM mx)
   SELECT dimension, key, count(*) AS n, {AVG} FROM sl GROUP BY dimension, key""")
def h17(t: Tables):
    m = F.col("match_id")
    total = F.lit(3.0) + m % 7 + m % 5 + m % 4
    rows = event_fixtures(t).withColumn("match_date", F.to_date("prediction_time")).withColumn(
        "actual", F.when(m % 3 == 0, F.lit("home_win")).when(m % 3 == 1, F.lit("draw")).otherwise(F.lit("away_win")))
    rows = rows.withColumn("p_home", (1 + m % 7) / total).withColumn("p_draw", (1 + m % 5) / total).withColumn("p_away", (1 + m % 4) / total)
    from ..functions import probability as P

    rows = V.with_memberships(rows.withColumns(P.metric_row("actual", *P.triple())), releases(t))
    return rounded(V.slices(rows, V.membership_dimensions()), "dimension", "key", "n")


DRIFT_SQL = PRED + """, l AS (SELECT 'p_home' AS feature, p_home AS value, prediction_time < TIMESTAMP '1998-01-01' AS ref FROM predictions UNION ALL SELECT 'home_odds', home_odds, prediction_time < TIMESTAMP '1998-01-01' FROM predictions
     UNION ALL SELECT 'draw_odds', CASE WHEN prediction_time < TIMESTAMP '1998-01-01' THEN draw_odds ELSE draw_odds * 1.2 END, prediction_time < TIMESTAMP '1998-01-01' FROM predictions),
   qs AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e, min(value) AS lo, max(value) AS hi, avg(value) AS rm FROM l WHERE ref GROUP BY feature),
   b AS (SELECT l.feature, ref, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM l JOIN qs ON l.feature = qs.feature GROUP BY 1, 2, 3),
   t AS (SELECT feature, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS nc, avg(value) FILTER (WHERE NOT ref) AS cm FROM l GROUP BY feature),
   g AS (SELECT feature, unnest(range(len(e) + 1)) AS bin FROM qs),
   sh AS (SELECT g.feature, greatest(coalesce(r.n, 0) / nr, 1e-6) AS p, greatest(coalesce(c.n, 0) / nc, 1e-6) AS q FROM g JOIN t ON g.feature = t.feature LEFT JOIN b r ON r.feature = g.feature AND r.bin = g.bin AND r.ref LEFT JOIN b c ON c.feature = g.feature AND c.bin = g.bin AND NOT c.ref),
   nm AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM sh), ps AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM nm GROUP BY feature),
   ou AS (SELECT l.feature, avg(CASE WHEN value < lo OR value > hi THEN 1e0 ELSE 0e0 END) AS outside FROM l JOIN qs ON l.feature = qs.feature WHERE NOT ref GROUP BY l.feature)
   SELECT ps.feature, round(psi, 6) + 0.0 AS psi, round(rm, 6) + 0.0 AS reference_mean, round(cm, 6) + 0.0 AS current_mean, round(outside, 6) + 0.0 AS outside FROM ps JOIN qs ON ps.feature = qs.feature JOIN t ON t.feature = ps.feature JOIN ou ON ou.feature = ps.feature"""


@query("h18_feature_drift", DRIFT_SQL)
def h18(t: Tables):
    ref = F.col("prediction_time") < F.lit("1998-01-01").cast("timestamp")
    p = t.predictions.withColumn("draw_odds", F.when(ref, F.col("draw_odds")).otherwise(F.col("draw_odds") * 1.2))
    long = lambda df: df.select("p_home", "home_odds", "draw_odds").unpivot([], ["p_home", "home_odds", "draw_odds"], "feature", "value")
    d = V.feature_drift(long(p.filter(ref)), long(p.filter(~ref)))
    return d.select("feature", r6("psi").alias("psi"), r6("reference_mean").alias("reference_mean"), r6("current_mean").alias("current_mean"), r6("outside_reference_range").alias("outside"))


@query("h21_experiment_manifest", f"""{PRED}, f AS (SELECT model_id, strftime(prediction_time, '%Y') AS fold_id, count(*) AS n FROM predictions GROUP BY 1, 2)
   SELECT model_id, string_agg(fold_id || '=' || n, ',' ORDER BY fold_id) AS folds, CAST(sum(n) AS BIGINT) AS prediction_count,
   'experiment_' || sha256('{{"model_id":"' || model_id || '","folds":[' || string_agg('{{"fold_id":"' || fold_id || '","model_id":"' || model_id || '","n":' || n || '}}', ',' ORDER BY fold_id) || '],"policy":"yearly"}}') AS experiment_id FROM f GROUP BY model_id""")
def h21(t: Tables):
    by_fold = V.metrics(t.predictions.withColumn("fold_id", F.date_format("prediction_time", "yyyy")), ["model_id", "fold_id"])
    m = V.manifest(by_fold.withColumnRenamed("model_id", "run").withColumn("model_id", F.col("run")), ["run"], {"policy": "yearly"})
    listed = F.array_join(F.transform("folds", lambda f: F.concat_ws("=", f["fold_id"], f["n"].cast("string"))), ",")
    body = F.to_json(F.struct(F.col("run").alias("model_id"), F.transform("folds", lambda f: F.struct(f["fold_id"], f["model_id"], f["n"])).alias("folds"), F.col("policy")))
    return m.select(F.col("run").alias("model_id"), listed.alias("folds"), "prediction_count", ids.content_id("experiment_", body).alias("experiment_id"))


# Claims: yearly metrics, with the log loss of one year and the count of another misreported and one year left out.
@query("h22_evidence_audit", f"""{PRED}, r AS (SELECT model_id, strftime(prediction_time, '%Y') AS fold_id, {row_metrics('p_')} FROM predictions), f AS (SELECT model_id, fold_id, CAST(count(*) AS DOUBLE) AS n, avg(log_loss) AS log_loss, avg(accuracy) AS accuracy, avg(brier) AS brier, avg(rps) AS rps FROM r GROUP BY 1, 2)
   SELECT model_id, fold_id, 'log_loss' AS metric, round(log_loss + 0.001, 6) + 0.0 AS claimed, round(log_loss, 6) + 0.0 AS actual FROM f WHERE fold_id = '1996' UNION ALL SELECT model_id, fold_id, 'n', n + 1, n FROM f WHERE fold_id = '1997'
   UNION ALL SELECT model_id, fold_id, m, NULL, round(CASE m WHEN 'n' THEN n WHEN 'log_loss' THEN log_loss WHEN 'accuracy' THEN accuracy WHEN 'brier' THEN brier ELSE rps END, 6) + 0.0 FROM f, (VALUES ('n'), ('log_loss'), ('accuracy'), ('brier'), ('rps')) AS v(m) WHERE fold_id = '1998'""")
def h22(t: Tables):
    by_fold = V.metrics(t.predictions.withColumn("fold_id", F.date_format("prediction_time", "yyyy")), ["model_id", "fold_id"])
    claims = by_fold.filter("fold_id <> '1998'").withColumn("log_loss", F.col("log_loss") + F.when(F.col("fold_id") == "1996", 0.001).otherwise(0.0)).withColumn(
        "n", F.col("n") + F.when(F.col("fold_id") == "1997", 1).otherwise(0))
    bad = V.evidence_mismatches(claims, by_fold, ["model_id", "fold_id"], 1e-6)
    return bad.select("model_id", "fold_id", "metric", r6("claimed").alias("claimed"), r6("actual").alias("actual"))
