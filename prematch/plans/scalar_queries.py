"""Sources (A*) and scalar functions (B*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ids, probability as P, strength as S, text as X
from ..functions.common import epoch, r6
from ..sources import readers as R
from ..sources import writers as W
from .bindings import Tables, ctes
from .registry import query

RAW = ctes("raw_results")
BOOL = """CASE WHEN lower(trim({0})) IN ('true','1','yes','y') THEN TRUE WHEN lower(trim({0})) IN ('false','0','no','n') THEN FALSE END"""
NEUTRAL = BOOL.format("neutral")
GOALS = "CASE WHEN TRY_CAST(trim({0}) AS DOUBLE) >= 0 AND TRY_CAST(trim({0}) AS DOUBLE) = floor(TRY_CAST(trim({0}) AS DOUBLE)) THEN CAST(TRY_CAST(trim({0}) AS DOUBLE) AS INTEGER) END"
HOME, AWAY = GOALS.format("home_score"), GOALS.format("away_score")
DAY = "TRY_CAST(trim(date) AS DATE)"
LABEL = "CASE WHEN {0} > {1} THEN 'home_win' WHEN {0} < {1} THEN 'away_win' WHEN {0} = {1} THEN 'draw' END"
MAPPING = {
    "match_date": "date", "home_team_name": "home_team", "away_team_name": "away_team", "competition_name": "tournament",
    "neutral": "neutral", "home_score": "home_score", "away_score": "away_score", "status": "status",
    "score_basis": "score_basis", "kickoff_at": "kickoff_text",
}


def raw(t: Tables):
    return t.view("raw_results")


@query("a1_mapped_scan", f"""{RAW}, p AS (SELECT *, {DAY} AS d, {HOME} AS h, {AWAY} AS a, {NEUTRAL} AS n,
    CASE WHEN trim(status) = '' THEN 'completed' WHEN lower(trim(status)) = 'ft' THEN 'completed'
         WHEN lower(trim(status)) IN ('scheduled','completed','postponed','cancelled') THEN lower(trim(status)) END AS st,
    CASE WHEN trim(score_basis) = '' THEN 'unknown' WHEN score_basis IN ('regulation_time','after_extra_time') THEN score_basis END AS sb
  FROM raw_results), v AS (SELECT *, concat_ws(',',
    CASE WHEN d IS NULL THEN 'match_date' END, CASE WHEN trim(home_team) = '' THEN 'home_team_name' END,
    CASE WHEN home_score = '2.5' THEN 'home_score' END, CASE WHEN away_score = '-1' THEN 'away_score' END,
    CASE WHEN n IS NULL THEN 'neutral' END, CASE WHEN st IS NULL THEN 'status' END, CASE WHEN sb IS NULL THEN 'score_basis' END,
    CASE WHEN row_no % 4 = 2 THEN 'kickoff_zone' END,
    CASE WHEN (h IS NULL) <> (a IS NULL) THEN 'unpaired_scores' END,
    CASE WHEN st = 'completed' AND (h IS NULL OR a IS NULL) THEN 'completed_without_score' END) AS violations FROM p)
  SELECT row_no, 'src:' || substr(sha256(concat_ws('|', 'src', CAST(d AS VARCHAR), trim(home_team), trim(away_team), tournament)), 1, 20) AS source_match_id,
    CAST(d AS VARCHAR) AS match_date,
    CASE row_no % 4 WHEN 1 THEN CAST(epoch(TRY_CAST(date AS TIMESTAMP)) AS BIGINT) + 66600
      WHEN 3 THEN CAST(epoch(TRY_CAST(date AS TIMESTAMP)) AS BIGINT) + 59400 END AS kickoff_epoch,
    trim(home_team) AS home_team, trim(away_team) AS away_team, n AS neutral, h AS home_score, a AS away_score, st AS status,
    sb AS score_basis, violations FROM v""")
def a1(t: Tables):
    rows = R.match_observations(raw(t), MAPPING, "src", "2025-01-01T00:00:00Z", {"FT": "completed"}, "completed")
    return rows.select(
        "row_no", "observation.source_match_id", F.col("observation.match_date").cast("string").alias("match_date"),
        F.when(F.col("row_no") % 4 != 0, epoch("observation.kickoff_at") + F.when(F.col("observation.match_date").isNull(), F.lit(None)).otherwise(0)).alias("kickoff_epoch"),
        F.col("observation.home_team_name").alias("home_team"), F.col("observation.away_team_name").alias("away_team"),
        "observation.neutral", "observation.home_score", "observation.away_score", "observation.status",
        "observation.score_basis", F.concat_ws(",", "violations").alias("violations"))


@query("a2_preset_scan", f"""{RAW} SELECT {DAY} IS NULL OR trim(home_team) = '' OR home_score = '2.5' OR away_score = '-1'
    OR {NEUTRAL} IS NULL OR {HOME} IS NULL OR {AWAY} IS NULL AS rejected, tournament, count(*) AS n,
    CAST(sum(CASE WHEN {NEUTRAL} THEN 1 ELSE 0 END) AS BIGINT) AS neutral_rows,
    CAST(coalesce(sum({HOME}), 0) AS BIGINT) AS home_goals FROM raw_results GROUP BY 1, 2""")
def a2(t: Tables):
    rows = R.preset_results(raw(t), "2025-01-01T00:00:00Z")
    return rows.groupBy((F.size("violations") > 0).alias("rejected"), F.col("observation.competition_name").alias("tournament")).agg(
        F.count("*").alias("n"), F.count_if("observation.neutral").alias("neutral_rows"),
        F.coalesce(F.sum("observation.home_score"), F.lit(0)).alias("home_goals"))


A3_SQL = f"""SELECT row_no, CAST({DAY} AS VARCHAR) AS match_date, trim(home_team) AS home_team, trim(away_team) AS away_team,
  {HOME} AS home_score, {AWAY} AS away_score, {NEUTRAL} AS neutral, {LABEL.format(HOME, AWAY)} AS outcome,
  concat_ws(',', CASE WHEN {DAY} IS NULL THEN 'bad_date' END, CASE WHEN trim(home_team) = '' THEN 'blank_team' END,
    CASE WHEN away_score = '-1' THEN 'negative_score' END,
    CASE WHEN away_score <> '-1' AND ({HOME} IS NULL OR {AWAY} IS NULL) THEN 'bad_score' END,
    CASE WHEN {NEUTRAL} IS NULL THEN 'bad_neutral' END) AS violations FROM raw_results"""


def _results(df):
    return df.select("row_no", F.col("match_date").cast("string").alias("match_date"), "home_team", "away_team", "home_score",
                     "away_score", "neutral", "outcome", F.concat_ws(",", "violations").alias("violations"))


@query("a3_results_load", f"{RAW} {A3_SQL}")
def a3(t: Tables):
    return _results(R.historical_results(raw(t)))


@query("a4_completed_results", f"{RAW} {A3_SQL} WHERE trim(home_score) <> '' AND trim(away_score) <> ''")
def a4(t: Tables):
    return _results(R.completed_results(raw(t)))


@query("a5_fixture_schedule", f"""{RAW} SELECT row_no, CAST({DAY} AS VARCHAR) AS match_date,
    CASE WHEN date = 'soon' AND row_no % 4 = 0 THEN '' WHEN row_no % 4 = 0 THEN '' WHEN row_no % 4 = 3 THEN substr(kickoff_text, 1, 10) || 'T16:30:00Z'
      ELSE substr(kickoff_text, 1, 10) || 'T18:30:00Z' END AS kickoff_at,
    trim(home_team) AS home_team, trim(away_team) AS away_team, {NEUTRAL} AS neutral, trim(status) AS status,
    concat_ws(',', CASE WHEN {DAY} IS NULL THEN 'bad_date' END, CASE WHEN trim(home_team) = '' THEN 'blank_team' END,
      CASE WHEN {NEUTRAL} IS NULL THEN 'bad_neutral' END) AS violations FROM raw_results""")
def a5(t: Tables):
    fixtures = R.fixture_schedule(raw(t).drop("kickoff_at").withColumnRenamed("kickoff_text", "kickoff_at"))
    return fixtures.select("row_no", F.col("match_date").cast("string").alias("match_date"), "kickoff_at", "home_team", "away_team",
                           "neutral", "status", F.concat_ws(",", "violations").alias("violations"))


def catalog_docs(t: Tables):
    """One catalog document per customer, written and read back as JSON text."""
    team = F.struct(F.concat(F.lit("T"), F.col("c_custkey")).alias("team_id"), F.col("c_name").alias("name"),
                    F.lit(None).cast("string").alias("fifa_code"), F.col("c_mktsegment").alias("confederation"))
    aliases = F.create_map(F.concat(F.lit("alias "), F.col("c_custkey")), F.concat(F.lit("T"), F.col("c_custkey")))
    return t.raw("customer").select(F.to_json(F.struct(F.array(team).alias("teams"), aliases.alias("aliases"))).alias("doc"))


@query("a6_json_catalog", """SELECT 'T' || c_custkey AS team_id, c_name AS name, c_mktsegment AS confederation,
  'alias ' || c_custkey AS label FROM customer""")
def a6(t: Tables):
    docs = R.parse_catalog(catalog_docs(t), "doc", R.TEAM_CATALOG)
    teams, aliases = R.catalog_entries(docs, "teams"), R.catalog_aliases(docs)
    return teams.join(aliases, teams.team_id == aliases.target_id).select("team_id", "name", "confederation", "label")


def membership_docs(t: Tables):
    """Per supplier, one release with two periods split at a date; suppliers without a nation row are unknown teams."""
    start, split = F.lit("1990-01-01"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("s_suppkey").cast("int") * 7).cast("string")
    periods = F.array(
        F.struct(F.lit("UEFA").alias("confederation"), start.alias("valid_from"), split.alias("valid_to")),
        F.struct(F.lit("AFC").alias("confederation"), split.alias("valid_from"), F.lit(None).cast("string").alias("valid_to")))
    meta = F.struct(F.lit("registry").alias("source"), F.lit("1995-06-01T00:00:00Z").alias("available_at"), F.lit("safe").alias("leakage_risk"))
    return t.raw("supplier").select(F.to_json(F.struct(
        (F.col("s_suppkey") % 97).cast("string").alias("team_id"), periods.alias("periods"), meta.alias("metadata"))).alias("doc"))


@query("a7_membership_scan", """SELECT CAST(s_suppkey % 97 AS VARCHAR) AS team_id, p AS confederation,
   CASE p WHEN 'UEFA' THEN '1990-01-01' ELSE CAST(CAST('1996-01-01' AS DATE) + CAST(s_suppkey AS INTEGER) * 7 AS VARCHAR) END AS valid_from,
   CASE p WHEN 'UEFA' THEN CAST(CAST('1996-01-01' AS DATE) + CAST(s_suppkey AS INTEGER) * 7 AS VARCHAR) END AS valid_to
   FROM supplier, (VALUES ('UEFA'), ('AFC')) AS x(p) WHERE s_suppkey % 97 IN (SELECT CASE WHEN c_custkey < 50 THEN c_custkey ELSE -c_custkey END FROM customer)""")
def a7(t: Tables):
    # the whole catalog, most of it under ids that no release names
    known = t.raw("customer").select(F.when(F.col("c_custkey") < 50, F.col("c_custkey")).otherwise(-F.col("c_custkey")).cast("string").alias("team_id"))
    periods = R.membership_periods(R.membership_releases(membership_docs(t), "doc", known))
    return periods.select("team_id", "confederation", F.col("valid_from").cast("string").alias("valid_from"),
                          F.col("valid_to").cast("string").alias("valid_to"))


@query("a8_observation_ingest", f"""{ctes("observations")}, v AS (SELECT record_id, concat_ws(',',
    CASE WHEN source = 'click' THEN 'publication_time_missing' END,
    CASE WHEN source <> 'click' AND available_at > TIMESTAMP '2024-01-20 00:00:00' THEN 'published_in_future' END,
    CASE WHEN record_id % 7 = 0 THEN 'legal_notes_missing' END, CASE WHEN record_id % 3 <> 0 THEN 'settlement_basis' END) AS violations FROM observations)
    SELECT violations, count(*) AS n, min(record_id) AS first_record FROM v GROUP BY violations""")
def a8(t: Tables):
    rows = t.observations.withColumn("available_at", F.when(F.col("source") != "click", F.col("available_at")))
    rows = rows.withColumn("legal_use_notes", F.when(F.col("record_id") % 7 == 0, F.lit("")).otherwise(F.lit("ok")))
    rows = rows.withColumn("score_basis", F.when(F.col("record_id") % 3 == 0, F.lit("regulation_time")))
    checked = R.observation_rejects(rows, "2024-01-20T00:00:00Z", True).withColumn("violations", F.concat_ws(",", "violations"))
    return checked.groupBy("violations").agg(F.count("*").alias("n"), F.min("record_id").alias("first_record"))


@query("a9_conformed_snapshots", f"""{ctes("observations")} SELECT CAST(team_id AS VARCHAR) AS fixture_id, CAST(floor(epoch(available_at)) AS BIGINT) AS at,
    round(home_odds, 6) + 0.0 AS market_home_odds, source FROM observations""")
def a9(t: Tables):
    snaps = t.observations.select(
        F.col("team_id").alias("fixture_id"), F.col("available_at").alias("snapshot_timestamp"), F.lit("a").alias("home_team"),
        F.lit("b").alias("away_team"), F.col("home_odds").alias("market_home_odds"), F.col("draw_odds").alias("market_draw_odds"),
        F.col("away_odds").alias("market_away_odds"), "source")
    stored = W.conform(snaps, "market_snapshots")
    return stored.select("fixture_id", F.unix_seconds("snapshot_timestamp").alias("at"), r6("market_home_odds").alias("market_home_odds"), "source")


@query("a10_feature_store", f"""{ctes("observations")} SELECT 'v1' AS feature_set_id, 'team_source' AS entity_type, team_id || ':' || source AS entity_id,
    CAST(CAST(available_at AS DATE) AS VARCHAR) AS feature_date, f AS feature_name,
    CAST(CASE f WHEN 'value' THEN value WHEN 'rank' THEN rank ELSE points END AS DOUBLE) AS feature_value
    FROM observations, (VALUES ('value'), ('rank'), ('points')) AS x(f) WHERE f <> 'points' OR points IS NOT NULL""")
def a10(t: Tables):
    day = F.to_date("available_at").cast("string")
    return W.to_feature_store(t.observations, ["team_id", "source"], ["value", "rank", "points"], "v1", "team_source", day)


@query("a11_prediction_ledger", f"""{ctes("predictions")} SELECT CAST(CAST(prediction_time AS DATE) AS VARCHAR) || ':' || home_id || ':' || away_id AS fixture_id,
    'm' AS model_id, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'home_win' WHEN p_draw >= p_away THEN 'draw' ELSE 'away_win' END AS predicted_outcome,
    round(greatest(p_home, p_draw, p_away), 6) + 0.0 AS model_confidence, 'open' AS status FROM predictions""")
def a11(t: Tables):
    h, d, a = P.triple()
    forecasts = t.predictions.select(
        F.to_date("prediction_time").alias("match_date"), F.col("home_id").cast("string").alias("home_team"),
        F.col("away_id").cast("string").alias("away_team"), P.argmax_outcome(h, d, a).alias("predicted_outcome"),
        F.greatest(h, d, a).alias("model_confidence"), h.alias("prob_home_win"), d.alias("prob_draw"), a.alias("prob_away_win"))
    led = W.to_prediction_ledger(forecasts, "m")
    return led.select("fixture_id", "model_id", "predicted_outcome", r6("model_confidence").alias("model_confidence"), "status")


@query("a13_run_audit", """SELECT 'run-' || o_orderkey AS run_id, o_orderstatus AS status, CAST(epoch(o_orderdate) AS BIGINT) AS started, o_custkey AS row_count
   FROM orders ORDER BY o_orderdate DESC, run_id DESC""")
def a13(t: Tables):
    runs = t.raw("orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"),
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("row_count"), F.lit("").alias("message"))
    audit = W.conform(runs, "scheduled_runs")
    return audit.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).select(
        "run_id", "status", epoch("started_at").alias("started"), "row_count")


@query("b1_text_to_boolean", f"{RAW} SELECT row_no, {NEUTRAL} AS flag FROM raw_results")
def b1(t: Tables):
    return raw(t).select("row_no", X.parse_bool("neutral").alias("flag"))


@query("b2_text_to_score", f"{RAW} SELECT row_no, {HOME} AS home, {AWAY} AS away, home_score = '2.5' AS home_bad, away_score = '-1' AS away_bad FROM raw_results")
def b2(t: Tables):
    return raw(t).select("row_no", X.parse_score("home_score").alias("home"), X.parse_score("away_score").alias("away"),
                         F.coalesce(X.score_is_invalid("home_score"), F.lit(False)).alias("home_bad"),
                         F.coalesce(X.score_is_invalid("away_score"), F.lit(False)).alias("away_bad"))


@query("b3_timestamp_utc", f"""{RAW} SELECT row_no, CASE row_no % 4 WHEN 1 THEN CAST(epoch(CAST(substr(kickoff_text, 1, 10) AS TIMESTAMP)) AS BIGINT) + 66600
    WHEN 3 THEN CAST(epoch(CAST(substr(kickoff_text, 1, 10) AS TIMESTAMP)) AS BIGINT) + 59400 END AS at,
    row_no % 4 = 2 AS naive FROM raw_results""")
def b3(t: Tables):
    naive = (F.trim("kickoff_text") != "") & ~X.has_zone("kickoff_text")
    return raw(t).select("row_no", epoch(X.parse_utc("kickoff_text")).alias("at"), naive.alias("naive"))


@query("b4_status_mapping", f"""{RAW} SELECT row_no, CASE WHEN trim(status) = '' THEN 'scheduled' WHEN lower(status) = 'ft' THEN 'completed'
    WHEN lower(status) = 'completed' THEN 'completed' END AS mapped FROM raw_results""")
def b4(t: Tables):
    return raw(t).select("row_no", X.map_status("status", {"FT": "completed"}).alias("mapped"))


@query("b5_score_basis", f"""{RAW} SELECT row_no, CASE WHEN score_basis = '' THEN 'unknown' WHEN score_basis = 'guess' THEN NULL ELSE score_basis END AS basis,
    score_basis <> 'regulation_time' AS conflict, score_basis = 'regulation_time' AS usable FROM raw_results""")
def b5(t: Tables):
    return raw(t).select("row_no", X.resolve_score_basis("score_basis", "regulation_time").alias("s")).select("row_no", "s.*")


@query("b6_name_normalisation", f"""{RAW} SELECT row_no, lower(regexp_replace(trim(home_team), '\\s+', ' ', 'g')) AS home,
    lower(regexp_replace(trim(away_team), '\\s+', ' ', 'g')) AS away FROM raw_results""")
def b6(t: Tables):
    named = X.normalize_names(raw(t), "home_team", "home")
    return named.select("row_no", "home", X.normalize_name("away_team").alias("away"))


@query("b7_outcome_label", f"{ctes('matches')} SELECT match_id, {LABEL.format('home_score', 'away_score')} AS outcome FROM matches")
def b7(t: Tables):
    return t.matches.select("match_id", P.outcome_label("home_score", "away_score").alias("outcome"))


@query("b8_deterministic_ids", f"""{ctes('matches')} SELECT match_id,
    'src:' || substr(sha256('src|' || CAST(match_date AS VARCHAR) || '|' || home_id || '|' || away_id), 1, 20) AS source_id,
    substr(sha256(CAST(match_date AS VARCHAR) || '|' || home_id || '|' || away_id || '|' || competition_id), 1, 20) AS canonical_id,
    'row_' || sha256(CAST(match_id AS VARCHAR)) AS content FROM matches""")
def b8(t: Tables):
    return t.matches.select(
        "match_id", ids.source_row_id(F.lit("src"), "match_date", "home_id", "away_id").alias("source_id"),
        ids.canonical_match_id("match_date", "home_id", "away_id", "competition_id").alias("canonical_id"),
        ids.content_id("row_", F.col("match_id").cast("string")).alias("content"))


SCOPE_SQL = """CASE WHEN gender = 'unknown' THEN 'review:gender_unknown' WHEN team_level = 'unknown' THEN 'review:team_level_unknown'
   WHEN official IS NULL THEN 'review:official_status_unknown' WHEN gender <> 'men' THEN 'exclude:gender_out_of_scope:' || gender
   WHEN team_level <> 'senior_a' THEN 'exclude:team_level_out_of_scope:' || team_level WHEN NOT official THEN 'exclude:unofficial_match'
   ELSE 'include:senior_mens_a_international' END"""


@query("b9_scope_decision", f"{RAW} SELECT row_no, {SCOPE_SQL} AS scope FROM raw_results")
def b9(t: Tables):
    return raw(t).select("row_no", X.scope_decision("gender", "team_level", "official").alias("s")).select(
        "row_no", F.concat_ws(":", "s.decision", "s.reason").alias("scope"))


@query("b10_row_validity", f"""{RAW}, v AS (SELECT concat_ws(',', CASE WHEN ({HOME} IS NULL) <> ({AWAY} IS NULL) THEN 'unpaired_scores' END,
    CASE WHEN {HOME} IS NULL OR {AWAY} IS NULL THEN 'completed_without_score' END) AS codes FROM raw_results)
    SELECT codes, count(*) AS n FROM v GROUP BY codes""")
def b10(t: Tables):
    rows = R.preset_results(raw(t), "2025-01-01T00:00:00Z")
    wanted = F.array(F.lit("unpaired_scores"), F.lit("completed_without_score"), F.lit("self_play"), F.lit("score_without_completion"))
    codes = F.filter("violations", lambda c: F.array_contains(wanted, c))
    return rows.select(F.concat_ws(",", codes).alias("codes")).groupBy("codes").agg(F.count("*").alias("n"))


@query("b11_pre_match_available", f"""{ctes("observations")} SELECT record_id FROM observations
    WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00' AND leakage_risk = 'safe'""")
def b11(t: Tables):
    from ..operators.asof import is_safe, published_by

    return published_by(t.observations.filter(is_safe()), "2024-01-15T00:00:00Z").select("record_id")


@query("b12_great_circle", f"""{ctes("observations")} SELECT record_id, round(2 * 6371.0088 * asin(least(1.0, sqrt(
    pow(sin(radians(48.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin(radians(2.0 - lon) / 2), 2)))), 4) + 0.0 AS km FROM observations""")
def b12(t: Tables):
    km = S.great_circle_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(2.0))
    return t.observations.select("record_id", (F.round(km, 4) + F.lit(0.0)).alias("km"))


FAIR = "(1 / home_odds + 1 / draw_odds + 1 / away_odds)"


@query("b13_devig", f"""{ctes("observations")} SELECT record_id, round(1 / home_odds / {FAIR}, 6) + 0.0 AS home, round(1 / draw_odds / {FAIR}, 6) + 0.0 AS draw,
    round(1 / away_odds / {FAIR}, 6) + 0.0 AS away, round({FAIR} - 1, 6) + 0.0 AS overround, round({FAIR}, 6) + 0.0 AS implied_total FROM observations""")
def b13(t: Tables):
    fair = P.devig(F.col("home_odds"), F.col("draw_odds"), F.col("away_odds"))
    return t.observations.select("record_id", fair.alias("f")).select(
        "record_id", *[r6(f"f.{c}").alias(c) for c in ("home", "draw", "away", "overround", "implied_total")])


EDGE_SQL = f"""SELECT row_id, prediction_time, p_home, p_draw, p_away, home_odds, draw_odds, away_odds, home_id, away_id, actual, model_id, q_home, q_draw, q_away,
   p_home * home_odds - 1 AS ev_home, p_draw * draw_odds - 1 AS ev_draw, p_away * away_odds - 1 AS ev_away,
   p_home - 1 / home_odds / {FAIR} AS edge_home, p_draw - 1 / draw_odds / {FAIR} AS edge_draw, p_away - 1 / away_odds / {FAIR} AS edge_away,
   {FAIR} AS implied_total FROM predictions"""
BEST_SQL = """SELECT *, CASE WHEN ev_home >= ev_draw AND ev_home >= ev_away THEN 'home_win' WHEN ev_draw >= ev_away THEN 'draw' ELSE 'away_win' END AS best_outcome FROM ({0}) AS e"""
DECIDED_SQL = """SELECT *, CASE best_outcome WHEN 'home_win' THEN edge_home WHEN 'draw' THEN edge_draw ELSE edge_away END AS best_edge,
   CASE best_outcome WHEN 'home_win' THEN ev_home WHEN 'draw' THEN ev_draw ELSE ev_away END AS best_expected_value FROM ({0}) AS b"""
EDGES_SQL = DECIDED_SQL.format(BEST_SQL.format(EDGE_SQL))
DECISION_SQL = "CASE WHEN best_edge >= 0.03 AND best_expected_value >= 0.02 THEN 'candidate_edge' ELSE 'no_edge' END"


@query("b14_market_edge", f"""{ctes("predictions")} SELECT row_id, round(1 / home_odds, 6) + 0.0 AS implied_home, round(ev_home, 6) + 0.0 AS ev_home,
    best_outcome, round(best_edge, 6) + 0.0 AS best_edge, round(best_expected_value, 6) + 0.0 AS best_expected_value,
    {DECISION_SQL} AS decision FROM ({EDGES_SQL}) AS d""")
def b14(t: Tables):
    from ..operators.decisions import market_edges

    e = market_edges(t.predictions)
    return e.select("row_id", r6(P.implied_probability("home_odds")).alias("implied_home"), r6("expected_value_home_win").alias("ev_home"),
                    "best_outcome", r6("best_edge").alias("best_edge"), r6("best_expected_value").alias("best_expected_value"), "decision")


@query("b15_kelly_fraction", f"""{ctes("predictions")} SELECT row_id, round(((home_odds - 1) * p_home - (1 - p_home)) / (home_odds - 1), 6) + 0.0 AS kelly FROM predictions""")
def b15(t: Tables):
    return t.predictions.select("row_id", r6(P.kelly_fraction(F.col("p_home"), F.col("home_odds"))).alias("kelly"))


ENT = "-({0}home * ln({0}home) + {0}draw * ln({0}draw) + {0}away * ln({0}away))"


@query("b16_entropy", f"""{ctes("predictions")} SELECT row_id, round({ENT.format('p_')}, 6) + 0.0 AS nats, round({ENT.format('p_')} / ln(3), 6) + 0.0 AS normalised FROM predictions""")
def b16(t: Tables):
    return t.predictions.select("row_id", r6(P.entropy_nats(*P.triple())).alias("nats"), r6(P.entropy_normalised(*P.triple())).alias("normalised"))


CONF_SQL = """CASE WHEN greatest({0}home, {0}draw, {0}away) >= 0.6 AND """ + ENT + """ / ln(3) <= 0.75 THEN 'High'
   WHEN greatest({0}home, {0}draw, {0}away) >= 0.45 THEN 'Medium' ELSE 'Low' END"""


@query("b17_probability_maps", f"""{ctes("predictions")} SELECT row_id, round(greatest(abs(p_home - q_home), abs(p_draw - q_draw), abs(p_away - q_away)), 6) + 0.0 AS disagreement,
    {CONF_SQL.format('p_')} AS confidence, round(0.3 * p_home + 0.7 * q_home, 6) + 0.0 AS blend_home FROM predictions""")
def b17(t: Tables):
    p, q = P.triple(), P.triple("q_")
    return t.predictions.select("row_id", r6(P.max_disagreement(p, q)).alias("disagreement"), P.confidence_label(*p).alias("confidence"),
                                r6(P.blend(p, q, 0.3)[0]).alias("blend_home"))


IMPORTANCE_SQL = """CASE WHEN lower(tournament) = 'fifa world cup' THEN 1.6e0 WHEN lower(tournament) LIKE '%world cup%' AND lower(tournament) LIKE '%qualification%' THEN 1.25e0
   WHEN lower(tournament) LIKE '%euro%' THEN 1.15e0 WHEN lower(tournament) LIKE '%friendly%' THEN 0.75e0 ELSE 1.0e0 END"""


@query("b18_elo_terms", f"""{ctes("matches")}, r AS (SELECT *, 1400 + home_id * 3.5e0 + CASE WHEN neutral THEN 0 ELSE 75 END AS rh, 1400 + away_id * 3.5e0 AS ra FROM matches)
    SELECT match_id, round(1 / (1 + pow(10, (ra - rh) / 400)), 6) + 0.0 AS expected, CASE WHEN home_score > away_score THEN 1e0 WHEN home_score = away_score THEN 0.5e0 ELSE 0e0 END AS actual,
    {IMPORTANCE_SQL} AS importance, round(CASE WHEN abs(home_score - away_score) <= 1 THEN 1e0 ELSE ln(abs(home_score - away_score) + 1) * 2.2 / (0.001 * abs(rh - ra) + 2.2) END, 6) + 0.0 AS margin,
    round(20 * {IMPORTANCE_SQL} * CASE WHEN abs(home_score - away_score) <= 1 THEN 1e0 ELSE ln(abs(home_score - away_score) + 1) * 2.2 / (0.001 * abs(rh - ra) + 2.2) END
      * (CASE WHEN home_score > away_score THEN 1e0 WHEN home_score = away_score THEN 0.5e0 ELSE 0e0 END - 1 / (1 + pow(10, (ra - rh) / 400))), 6) + 0.0 AS change FROM r""")
def b18(t: Tables):
    rh, ra = F.lit(1400) + F.col("home_id") * 3.5, F.lit(1400) + F.col("away_id") * 3.5
    h, a, imp = F.col("home_score"), F.col("away_score"), S.importance("tournament")
    eff = rh + S.home_advantage("neutral")
    return t.matches.select("match_id", r6(S.expected_score(eff, ra)).alias("expected"), S.actual_score(h, a).alias("actual"), imp.alias("importance"),
                            r6(S.margin_multiplier(h, a, eff - ra)).alias("margin"), r6(S.elo_change(rh, ra, h, a, "neutral", imp)).alias("change"))


@query("b19_fixture_weight", f"""{ctes("matches")} SELECT match_id, CASE tournament WHEN 'FIFA World Cup' THEN 1e0 WHEN 'FIFA World Cup qualification' THEN 0.75e0
    WHEN 'Friendly' THEN 0.35e0 ELSE 0.5e0 END AS weight FROM matches""")
def b19(t: Tables):
    return t.matches.select("match_id", X.fixture_tournament_weight("tournament").alias("weight"))


@query("b20_poisson_pmf", """SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey, round(exp(-l_quantity / 10) * pow(l_quantity / 10, l_linenumber) / factorial(l_linenumber), 6) + 0.0 AS pmf,
    round(exp(-l_quantity / 10), 6) + 0.0 AS pmf0 FROM lineitem""")
def b20(t: Tables):
    rate = F.col("l_quantity") / 10
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_partkey",
                                    r6(P.poisson_pmf(F.col("l_linenumber"), rate)).alias("pmf"), r6(P.poisson_pmf(F.lit(0), rate)).alias("pmf0"))


ARGMAX_SQL = "CASE WHEN {0}home >= {0}draw AND {0}home >= {0}away THEN 'home_win' WHEN {0}draw >= {0}away THEN 'draw' ELSE 'away_win' END"
P_ACTUAL = "CASE actual WHEN 'home_win' THEN {0}home WHEN 'draw' THEN {0}draw ELSE {0}away END"


@query("b21_probability_checks", f"""{ctes("predictions")} SELECT row_id, abs(p_home + p_draw + p_away - 1) <= 1e-9 AS valid, {ARGMAX_SQL.format('p_')} AS predicted,
    round({P_ACTUAL.format('p_')}, 6) + 0.0 AS p_actual FROM predictions""")
def b21(t: Tables):
    return t.predictions.select("row_id", P.is_distribution(*P.triple()).alias("valid"), P.argmax_outcome(*P.triple()).alias("predicted"),
                                r6(P.pick("actual", *P.triple())).alias("p_actual"))


@query("b22_availability_weight", f"""{ctes("players")} SELECT record_id, match_id, CASE trim(lower(status_text)) WHEN 'available' THEN 1e0 WHEN 'doubtful' THEN 0.25e0
    WHEN 'out' THEN 0e0 WHEN 'suspended' THEN 0e0 WHEN 'limited' THEN 0.65e0 WHEN 'fit' THEN 1e0 ELSE 0.5e0 END AS weight FROM players""")
def b22(t: Tables):
    return t.players.select("record_id", "match_id", X.availability_weight("status_text").alias("weight"))


@query("b23_recency_weight", f"""{ctes("matches")}, w AS (SELECT match_id, pow(0.5, date_diff('day', match_date, (SELECT max(match_date) FROM matches)) / 2190e0) AS w FROM matches)
    SELECT match_id, round(w / (SELECT avg(w) FROM w), 6) + 0.0 AS weight FROM w""")
def b23(t: Tables):
    from ..operators.classifiers import recency_weights

    return recency_weights(t.matches, "match_date", 2190.0).select("match_id", r6("weight").alias("weight"))


@query("b24_returns_and_clv", f"""{ctes("predictions")} SELECT row_id, round(CASE WHEN actual = 'home_win' THEN 2 * (home_odds - 1) ELSE -2 END, 6) + 0.0 AS realised,
    round(home_odds / (home_odds * (0.9 + p_draw / 5)) - 1, 6) + 0.0 AS clv,
    CASE WHEN p_home > q_home THEN 'market_toward_home' WHEN p_home < q_home THEN 'market_away_from_home' ELSE 'market_unchanged' END AS direction
    FROM predictions WHERE home_odds * (0.9 + p_draw / 5) > 1 AND home_odds > 1""")
def b24(t: Tables):
    closing = F.col("home_odds") * (0.9 + F.col("p_draw") / 5)
    rows = t.predictions.select(
        "row_id", r6(P.realised_return(F.lit("home_win"), "actual", F.col("home_odds"), F.col("draw_odds"), F.col("away_odds"), F.lit(2.0))).alias("realised"),
        r6(P.closing_line_value(F.col("home_odds"), closing)).alias("clv"),
        P.market_direction(F.lit("home"), F.col("p_home") - F.col("q_home")).alias("direction"))
    return rows.filter(F.col("clv").isNotNull())


@query("b25_rank_bucket", f"""{ctes("observations")} SELECT record_id, CAST(CASE WHEN rank <= 10 THEN 1 WHEN rank <= 25 THEN 2 WHEN rank <= 50 THEN 3 WHEN rank <= 100 THEN 4 ELSE 5 END AS INTEGER) AS bucket FROM observations""")
def b25(t: Tables):
    return t.observations.select("record_id", P.rank_bucket(F.col("rank")).alias("bucket"))


@query("b26_json_payload", f"""{ctes("observations")} SELECT record_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    '{{"record_id":' || record_id || ',"k":' || json_extract_string(props, '$.k') || '}}' AS payload FROM observations""")
def b26(t: Tables):
    decoded = t.observations.withColumn("k", X.decode_payload("props", "k BIGINT")["k"])
    return decoded.select("record_id", "k", X.encode_payload("record_id", "k").alias("payload"))


@query("b27_winner_name", f"""{ctes("predictions")} SELECT row_id, CASE {ARGMAX_SQL.format('p_')} WHEN 'home_win' THEN 'T' || home_id WHEN 'away_win' THEN 'T' || away_id ELSE 'Draw' END AS winner FROM predictions""")
def b27(t: Tables):
    name = lambda c: F.concat(F.lit("T"), F.col(c))
    return t.predictions.select("row_id", P.winner_name(P.argmax_outcome(*P.triple()), name("home_id"), name("away_id")).alias("winner"))
