"""Feature families (E1-E15, E22-E26). One operator serves both sides of a match.

Contexts are rows (match_id, home_id, away_id, prediction_time, ...). Families that read observation
tables expand contexts to one row per side, do a single as-of read for both, and pair the sides again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import probability as P
from ..functions import strength as S
from ..functions.common import compact_codes, micros
from ..functions.text import availability_weight
from . import asof as A
from .assemble import combined_reason, difference, explode_features, feature, text_array
from .history import team_rows
from .skew import HOT_ROWS, rolling

# Competition kinds, stages, confederations and manual fields of the data contract.
KINDS = ("world_cup", "world_cup_qualifier", "continental_championship", "continental_qualifier", "nations_league",
         "friendly", "fifa_series", "regional_senior_tournament", "intercontinental_playoff", "other_senior_a")
STAGES = ("group_or_league", "knockout", "playoff", "final", "other")
CONFEDERATIONS = ("AFC", "CAF", "CONCACAF", "CONMEBOL", "OFC", "UEFA")
MANUAL_COUNTS = ("manager_tenure_days", "top_five_league_players", "champions_league_players")
MANUAL_BOUNDS = {"squad_average_age": (15, 60), "timezone_shift_hours": (-24, 24), "altitude_m": (-500, 9000)}
MANUAL_FIELDS = (
    "manager_tenure_days", "squad_average_age", "top_five_league_players", "champions_league_players", "captain_available",
    "star_available", "goalkeeper_strength_proxy", "rotation_risk", "timezone_shift_hours", "altitude_m",
    "climate_stress_proxy", "must_win", "draw_utility", "elimination_risk",
)


def sides(contexts: DataFrame, keep: list[str] = ("prediction_time",)) -> DataFrame:
    pair = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("team_id")) for s in ("home", "away")])).alias("s")
    return contexts.select("match_id", *keep, pair).select("match_id", *keep, "s.*")


def pair_sides(rows: DataFrame, columns: list[str], keep: list[str] = ("prediction_time",)) -> DataFrame:
    """Side rows back to one row per match with structs ``home`` and ``away``."""
    packed = F.struct(*columns)
    return rows.groupBy("match_id", *keep).agg(
        *[F.max(F.when(F.col("side") == s, packed)).alias(s) for s in ("home", "away")])


# ---- form and rest -------------------------------------------------------------------------------

def form(history: DataFrame, windows: tuple[int, ...], rates: bool = False) -> DataFrame:
    """Wide form per (match, side) from recent_history: matches used and means over each window."""
    out = history
    for n in windows:
        recent = F.slice("history", 1, n)
        used = F.size(recent)

        def mean(value) -> Column:
            total = F.aggregate(recent, F.lit(0), lambda acc, m: acc + value(m).cast("int"))
            return F.when(used > 0, total / used)

        out = (
            out.withColumn(f"used_{n}", used)
            .withColumn(f"points_{n}", mean(lambda m: m["pts"]))
            .withColumn(f"goal_diff_{n}", mean(lambda m: m["gf"] - m["ga"]))
            .withColumn(f"goals_for_{n}", mean(lambda m: m["gf"]))
            .withColumn(f"goals_against_{n}", mean(lambda m: m["ga"]))
        )
        if rates:
            out = out.withColumn(f"clean_sheet_{n}", mean(lambda m: m["ga"] == 0)).withColumn(
                f"failed_to_score_{n}", mean(lambda m: m["gf"] == 0))
    return out


FORM_NAMES = {"points": "points_per_match", "goal_diff": "goal_diff_per_match", "goals_for": "goals_for_per_match",
              "goals_against": "goals_against_per_match"}
RATE_NAMES = {"clean_sheet": "clean_sheet_rate", "failed_to_score": "failed_to_score_rate"}


def form_features(history: DataFrame, contexts: DataFrame, windows: tuple[int, ...], rates: bool = False) -> DataFrame:
    """Long form rows; lineage lists the matches a window used."""
    wide = form(history, windows, rates).join(contexts.select("match_id", "prediction_time"), "match_id")
    rows = []
    for n in windows:
        lineage = F.transform(F.slice("history", 1, n), lambda m: m["m"].cast("string"))
        name = lambda metric: F.concat(F.lit("form."), F.col("side"), F.lit(f".{metric}_{n}"))
        rows.append(feature(name("matches_used"), F.col(f"used_{n}"), lineage=lineage))
        for column, metric in {**FORM_NAMES, **(RATE_NAMES if rates else {})}.items():
            rows.append(feature(name(metric), F.col(f"{column}_{n}"), F.lit(A.NO_HISTORY), lineage))
    return explode_features(wide, rows)


def form_feature_names(windows: tuple[int, ...], rates: bool = False) -> list[str]:
    metrics = ["matches_used", *FORM_NAMES.values(), *(RATE_NAMES.values() if rates else ())]
    return [f"form.{s}.{m}_{n}" for s in ("home", "away") for n in windows for m in metrics]


def replay_form(matches: DataFrame, windows: tuple[int, ...] = (5, 10), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Form in plain match order with neutral defaults where a team has no earlier match."""
    rows = team_rows(matches, ["home_id", "away_id"]).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    exprs = {}
    for n in windows:
        for column, default in (("points", 1.0), ("goal_diff", 0.0), ("goals_for", 1.0), ("goals_against", 1.0)):
            exprs[f"form_{n}_{column}_per_match"] = (F.avg(column), -n, -1)
    rolled = rolling(rows, ["team_id"], ["match_date", "home_id", "away_id", "match_id"], max(windows),
                     micros(F.col("match_date").cast("timestamp")), exprs, hot_rows)
    fills = {name: F.coalesce(F.col(name), F.lit(0.0 if "goal_diff" in name else 1.0)) for name in exprs}
    return rolled.withColumns(fills).select("match_id", "side", "team_id", *exprs)


def form_before(matches: DataFrame, cutoff: str, windows: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Form per team after its last match before a date, for fixtures not played yet."""
    rows = team_rows(matches.filter(F.col("match_date") < F.lit(cutoff).cast("date")), ["home_id", "away_id"])
    w = Window.partitionBy("team_id").orderBy(*[F.col(c).desc() for c in ("match_date", "home_id", "away_id", "match_id")])
    last = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(windows))
    diff = F.col("goals_for") - F.col("goals_against")
    aggs = []
    for n in windows:
        inside = F.col("rn") <= n
        for name, value in (("points", F.col("points")), ("goal_diff", diff), ("goals_for", F.col("goals_for")),
                            ("goals_against", F.col("goals_against"))):
            aggs.append(F.avg(F.when(inside, value)).alias(f"form_{n}_{name}_per_match"))
    return last.groupBy("team_id").agg(*aggs)


def attach_team_features(fixtures: DataFrame, team_features: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Left-join one team table to both sides, prefixing columns and filling defaults."""
    out = fixtures
    for side in ("home", "away"):
        renamed = team_features.select(F.col("team_id").alias(f"{side}_id"),
                                       *[F.col(c).alias(f"{side}_{c}") for c in team_features.columns if c != "team_id"])
        out = out.join(renamed, f"{side}_id", "left")
        out = out.withColumns({f"{side}_{c}": F.coalesce(F.col(f"{side}_{c}"), F.lit(v)) for c, v in defaults.items()})
    return out


def rest(history: DataFrame, contexts: DataFrame) -> DataFrame:
    """Long rest-day rows per side and their difference; date-only gaps are imputed calendar days."""
    rows = history.withColumn("prior", F.when(F.size("history") > 0, F.try_element_at("history", F.lit(1)))).join(
        contexts.select("match_id", "prediction_time", "kickoff_at", "match_date"), "match_id")
    exact = F.col("kickoff_at").isNotNull() & F.col("prior.k").isNotNull()
    value = F.when(exact, (micros("kickoff_at") - micros("prior.k")) / 86_400_000_000.0).otherwise(
        F.date_diff("match_date", F.col("prior.d")).cast("double"))
    method = F.when(F.col("prior").isNotNull() & ~exact, F.lit("calendar_days"))
    reason = F.when(F.col("prior").isNull(), F.lit(A.NO_HISTORY)).when(~exact, F.lit(A.PRECISION))
    rows = rows.withColumn("days", F.when(F.col("prior").isNotNull(), value)).withColumn("method", method).withColumn(
        "why", reason).withColumn("ref", F.col("prior.m").cast("string"))
    paired = pair_sides(rows, ["days", "method", "why", "ref"])
    both = text_array(F.col("home.ref"), F.col("away.ref"))
    feats = [feature(f"schedule.{s}.rest_days", F.col(f"{s}.days"), F.col(f"{s}.why"), text_array(F.col(f"{s}.ref")), F.col(f"{s}.method"))
             for s in ("home", "away")]
    diff = F.col("home.days") - F.col("away.days")
    diff_why = F.when(diff.isNull(), F.coalesce(F.col("home.why"), F.col("away.why"))).otherwise(F.lit(A.PRECISION))
    feats.append(feature("schedule.rest_days_diff_home_minus_away", diff, diff_why, both,
                         F.when(diff.isNotNull(), F.coalesce(F.col("home.method"), F.col("away.method")))))
    return explode_features(paired, feats)


# ---- strength --------------------------------------------------------------------------------------

def rating_features(contexts: DataFrame, snapshots: DataFrame, default: float = S.ELO_START,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ratings from snapshots dated strictly before the cutoff's day, expected scores and difference.

    snapshots: team_id, rating, effective_date, snapshot_order, match_id and optionally usable_at, the
    time at which everything the rating is built from was published. "Strictly before the day" is the
    same as "the next midnight has passed", which gives one time to compare.
    """
    left = sides(contexts, ["prediction_time", "neutral"])
    midnight = F.date_add("effective_date", 1).cast("timestamp")
    usable = F.greatest(midnight, F.col("usable_at")) if "usable_at" in snapshots.columns else midnight
    known = A.asof_latest(left, snapshots.withColumn("__usable", usable), ["team_id"], "prediction_time", "__usable",
                          ["rating", "match_id"], ["effective_date", "snapshot_order"], False, "snap", hot_rows)
    known = known.withColumn("rating", F.coalesce("snap.rating", F.lit(default))).withColumn("known", F.col("snap").isNotNull())
    known = known.withColumn("ref", F.col("snap.match_id").cast("string"))
    p = pair_sides(known, ["rating", "known", "ref"], ["prediction_time", "neutral"])
    h, a = F.col("home.rating"), F.col("away.rating")
    expected = S.expected_score(h + S.home_advantage("neutral"), a)
    method = lambda ok: F.when(~ok, F.lit(f"default_rating={default:g}"))
    either = F.col("home.known") & F.col("away.known")
    refs = text_array(F.col("home.ref"), F.col("away.ref"))
    why = F.lit(A.NO_HISTORY)
    return explode_features(p, [
        feature("elo.home_rating", h, why, text_array(F.col("home.ref")), method(F.col("home.known"))),
        feature("elo.away_rating", a, why, text_array(F.col("away.ref")), method(F.col("away.known"))),
        feature("elo.rating_diff_home_minus_away", h - a, why, refs, method(either)),
        feature("elo.expected_home_score", expected, why, refs, method(either)),
        feature("elo.expected_away_score", 1.0 - expected, why, refs, method(either)),
    ])


def glicko_features(contexts: DataFrame, history: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Glicko state after the last period whose results were eligible, its deviation grown to the cutoff.

    history: team_id, effective_date, rating, deviation, available_at (when the period's results were usable).
    """
    left = sides(contexts)
    known = A.asof_latest(left, history, ["team_id"], "prediction_time", "available_at",
                          ["rating", "deviation", "effective_date"], ["effective_date"], False, "g", hot_rows)
    days = F.date_diff(F.to_date("prediction_time"), F.col("g.effective_date")).cast("double")
    known = (
        known.withColumn("rating", F.coalesce("g.rating", F.lit(S.GLICKO_START[0])))
        .withColumn("deviation", F.coalesce(S.inflate_deviation(F.col("g.deviation"), days), F.lit(S.GLICKO_START[1])))
        .withColumn("known", F.col("g").isNotNull())
    )
    p = pair_sides(known, ["rating", "deviation", "known"])
    return explode_features(p, [
        feature(f"glicko.{s}.{m}", F.col(f"{s}.{m}"), F.lit(A.NO_HISTORY), None,
                F.when(~F.col(f"{s}.known"), F.lit("declared_glicko_prior")))
        for s in ("home", "away") for m in ("rating", "deviation")])


# ---- competition, ranking, market, travel, squads ---------------------------------------------------

def competition_features(contexts: DataFrame, competitions: DataFrame, stages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Kind one-hots, confederation flag, and stage one-hots and leg as of the cutoff.

    competitions: competition_id, kind, confederation; stages: match_id, stage, leg_number, available_at, leakage_risk, record_id.
    """
    catalog = competitions.select("competition_id", "kind", "confederation", F.lit(True).alias("listed"))
    rows = contexts.select("match_id", "prediction_time", "competition_id").join(catalog, "competition_id", "left")
    rows = A.asof_with_reason(rows, stages, ["match_id"], "prediction_time", ["stage", "leg_number", "record_id"], ["record_id"],
                              out="st", hot_rows=hot_rows)
    unlisted = F.lit(A.UPSTREAM)
    listed = lambda c: F.when(F.col("listed"), c.cast("double"))
    ref = text_array(F.col("st.record_id"))
    feats = [feature(f"competition.kind.{k}", listed(F.col("kind") == k), unlisted) for k in KINDS]
    feats.append(feature("competition.confederation_specific", listed(F.col("confederation").isNotNull()), unlisted))
    feats += [feature(f"competition.stage.{s}", (F.col("st.stage") == s).cast("double"), F.col("st_reason"), ref) for s in STAGES]
    leg_reason = F.coalesce(F.col("st_reason"), F.lit("not_applicable"))
    feats.append(feature("competition.leg_number", F.col("st.leg_number"), leg_reason, ref))
    return explode_features(rows, feats)


def ranking_features(contexts: DataFrame, observations: DataFrame, max_age_days: float | None = None,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Latest rank and points of both sides and their differences."""
    r = A.asof_with_reason(sides(contexts), observations, ["team_id"], "prediction_time", ["rank", "points", "record_id"],
                           ["record_id"], max_age_days, "o", hot_rows)
    r = (r.withColumn("rank", F.col("o.rank")).withColumn("points", F.col("o.points")).withColumn("ref", F.col("o.record_id"))
         .withColumn("why", F.col("o_reason")).withColumn("points_why", F.coalesce("o_reason", F.lit(A.UPSTREAM))))
    p = pair_sides(r, ["rank", "points", "ref", "why", "points_why"])
    refs = text_array(F.col("home.ref"), F.col("away.ref"))
    feats = []
    for s in ("home", "away"):
        feats.append(feature(f"ranking.{s}.rank", F.col(f"{s}.rank"), F.col(f"{s}.why"), text_array(F.col(f"{s}.ref"))))
        feats.append(feature(f"ranking.{s}.points", F.col(f"{s}.points"), F.col(f"{s}.points_why"), text_array(F.col(f"{s}.ref"))))
    first = lambda w: F.coalesce(F.when(F.col(f"home.{w[0]}").isNull(), F.col(f"home.{w[1]}")), F.col(f"away.{w[1]}"))
    for name, pair in (("rank", ("rank", "why")), ("points", ("points", "points_why"))):
        feats.append(feature(f"ranking.{name}_diff_home_minus_away", F.col(f"home.{name}") - F.col(f"away.{name}"), first(pair), refs))
    return explode_features(p, feats)


def ranking_trends(contexts: DataFrame, observations: DataFrame, max_age_days: float | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Changes against the adjacent earlier publication of the same source, and the rank bucket."""
    prevs = A.previous_publication(observations, ["team_id"], ["rank", "points", "record_id"], ["record_id"], hot_rows)
    unsafe = observations.filter(~A.is_safe()).withColumn("prev", F.lit(None).cast(prevs.schema["prev"].dataType))
    r = A.asof_with_reason(sides(contexts), prevs.unionByName(unsafe), ["team_id"], "prediction_time",
                           ["rank", "points", "record_id", "prev"], ["record_id"], max_age_days, "o", hot_rows)
    gap = (micros("o.available_at") - micros("o.prev.available_at")) / 86_400_000_000.0
    base = F.coalesce(F.col("o_reason"), F.lit(A.NO_HISTORY))
    points_why = F.when(F.col("o.prev").isNotNull(), F.lit(A.UPSTREAM)).otherwise(base)
    both = text_array(F.col("o.record_id"), F.col("o.prev.record_id"))
    name = lambda m: F.concat(F.lit("ranking_trend."), F.col("side"), F.lit(f".{m}"))
    return explode_features(r, [
        feature(name("rank_bucket"), F.when(F.col("o").isNotNull(), P.rank_bucket(F.col("o.rank"))), base, text_array(F.col("o.record_id"))),
        feature(name("rank_improvement"), F.col("o.prev.rank") - F.col("o.rank"), base, both),
        feature(name("points_change"), F.col("o.points") - F.col("o.prev.points"), points_why, both),
        feature(name("publication_gap_days"), gap, base, both),
    ])


def market_features(contexts: DataFrame, odds: DataFrame) -> DataFrame:
    """Consensus over the latest safe quote per source at the cutoff, and its move from the opening quotes.

    contexts: match_id, prediction_time; odds: match_id, source, available_at, leakage_risk, record_id, *_odds.
    """
    joined = odds.join(contexts.select("match_id", "prediction_time"), "match_id")
    seen = odds.select("match_id").distinct().withColumn("seen", F.lit(True))
    eligible = joined.filter(A.is_safe() & (F.col("available_at") <= F.col("prediction_time")))
    per_source = A.first_and_last(eligible, ["match_id", "prediction_time", "source"], ["available_at", "record_id"],
                                  ["available_at", "record_id", "home_odds", "draw_odds", "away_odds"])
    fair = lambda side: P.devig(F.col(f"{side}.home_odds"), F.col(f"{side}.draw_odds"), F.col(f"{side}.away_odds"))
    per_source = per_source.withColumn("lf", fair("latest")).withColumn("of", fair("opening"))
    age = (micros("prediction_time") - micros("latest.available_at")) / 3_600_000_000.0
    agg = per_source.groupBy("match_id", "prediction_time").agg(
        F.count("*").alias("n"), F.avg("lf.overround").alias("over"), F.max(age).alias("age"),
        *[F.avg(f"lf.{o}").alias(f"l_{o}") for o in ("home", "draw", "away")],
        *[F.avg(f"of.{o}").alias(f"o_{o}") for o in ("home", "draw", "away")],
        F.array_sort(F.collect_set(F.col("latest.record_id").cast("string"))).alias("refs"),
        F.array_sort(F.collect_set(F.col("opening.record_id").cast("string"))).alias("orefs"),
    )
    rows = contexts.select("match_id", "prediction_time").join(agg, ["match_id", "prediction_time"], "left").join(seen, "match_id", "left")
    why = F.when(F.col("seen"), F.lit(A.INTEGRITY)).otherwise(F.lit(A.UPSTREAM))
    refs = F.coalesce(F.col("refs"), F.array().cast("array<string>"))
    both = F.coalesce(F.array_sort(F.array_union("refs", "orefs")), F.array().cast("array<string>"))
    feats = [feature("market.consensus.source_count", F.col("n"), why, refs),
             feature("market.consensus.average_overround", F.col("over"), why, refs),
             feature("market.consensus.oldest_source_snapshot_age_hours", F.col("age"), why, refs)]
    for o in ("home", "draw", "away"):
        feats.append(feature(f"market.consensus.{o}_fair_probability", F.col(f"l_{o}"), why, refs))
        feats.append(feature(f"market.consensus.{o}_fair_probability_move_from_open", F.col(f"l_{o}") - F.col(f"o_{o}"), why, both))
    return explode_features(rows, feats)


def travel_features(contexts: DataFrame, locations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Neutral flag and distances from each side's reference place to the venue.

    contexts add venue_id and neutral; locations: place_kind (venue or team), place_id, lat, lon, available_at,
    leakage_risk, record_id. Venue and both teams are one as-of read.
    """
    asks = F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(kind).alias("place_kind"), F.col(c).alias("place_id"))
        for role, kind, c in (("venue", "venue", "venue_id"), ("home", "team", "home_id"), ("away", "team", "away_id"))]))
    left = contexts.select("match_id", "prediction_time", "neutral", asks.alias("a")).select("match_id", "prediction_time", "neutral", "a.*")
    r = A.asof_with_reason(left, locations, ["place_kind", "place_id"], "prediction_time", ["lat", "lon", "record_id"],
                           ["record_id"], None, "o", hot_rows)
    r = r.withColumn("lat", F.col("o.lat")).withColumn("lon", F.col("o.lon")).withColumn("ref", F.col("o.record_id"))
    packed = F.struct("lat", "lon", "ref", F.col("o_reason").alias("why"))
    p = r.groupBy("match_id", "prediction_time", "neutral").agg(
        *[F.max(F.when(F.col("role") == x, packed)).alias(x) for x in ("venue", "home", "away")])
    km = {s: S.great_circle_km(F.col(f"{s}.lat"), F.col(f"{s}.lon"), F.col("venue.lat"), F.col("venue.lon")) for s in ("home", "away")}
    why = {s: F.when(km[s].isNull(), combined_reason(F.col(f"{s}.why"), F.col("venue.why"))) for s in ("home", "away")}
    refs = {s: text_array(F.col(f"{s}.ref"), F.col("venue.ref")) for s in ("home", "away")}
    feats = [feature("context.match.neutral_site", F.col("neutral").cast("double"))]
    feats += [feature(f"travel.{s}.reference_distance_km", km[s], why[s], refs[s]) for s in ("home", "away")]
    feats.append(difference("travel.reference_distance_diff_home_minus_away_km", km["home"], km["away"], why["home"], why["away"],
                            text_array(F.col("home.ref"), F.col("away.ref"), F.col("venue.ref"))))
    return explode_features(p, feats)


SQUAD_METRICS = ("mean_availability_probability", "expected_unavailable_player_count", "minutes_coverage_ratio",
                 "minutes_weighted_availability")


def squad_summary(contexts: DataFrame, players: DataFrame) -> DataFrame:
    """Per (match, side): latest safe status per player at the cutoff, aggregated. players: match_id, side, player_id, ..."""
    joined = players.join(contexts.select("match_id", "prediction_time"), "match_id")
    latest = A.latest_per_as_of(joined, ["match_id", "side", "player_id"], "prediction_time", ["record_id", "probability", "minutes"])
    p, m = F.col("probability"), F.col("minutes")
    return latest.groupBy("match_id", "side").agg(
        F.count("*").alias("players"), F.avg(p).alias("mean_availability_probability"),
        F.sum(1.0 - p).alias("expected_unavailable_player_count"),
        (F.count(m) / F.count("*")).alias("minutes_coverage_ratio"),
        F.try_divide(F.sum(m * p), F.nullif(F.sum(m), F.lit(0.0))).alias("minutes_weighted_availability"),
        F.array_sort(F.collect_set(F.col("record_id").cast("string"))).alias("refs"),
    )


def squad_features(contexts: DataFrame, players: DataFrame) -> DataFrame:
    summary = squad_summary(contexts, players)
    seen = players.select("match_id", "side").distinct().withColumn("seen", F.lit(True))
    base = contexts.select("match_id", "prediction_time", F.explode(F.array(F.lit("home"), F.lit("away"))).alias("side"))
    rows = base.join(summary, ["match_id", "side"], "left").join(seen, ["match_id", "side"], "left")
    rows = rows.withColumn("why", F.when(F.col("players").isNull(), F.when(F.col("seen"), F.lit(A.INTEGRITY)).otherwise(F.lit(A.UPSTREAM))).otherwise(
        F.lit(A.UPSTREAM)))
    rows = rows.withColumn("players", F.coalesce("players", F.lit(0)))
    p = pair_sides(rows, ["players", *SQUAD_METRICS, "refs", "why"])
    feats = []
    for s in ("home", "away"):
        lin = F.col(f"{s}.refs")
        feats.append(feature(f"squad.{s}.player_observation_count", F.col(f"{s}.players"), lineage=lin))
        feats += [feature(f"squad.{s}.{m}", F.col(f"{s}.{m}"), F.col(f"{s}.why"), lin) for m in SQUAD_METRICS]
    both = F.array_sort(F.array_union(F.coalesce("home.refs", F.array().cast("array<string>")), F.coalesce("away.refs", F.array().cast("array<string>"))))
    for m, name in (("mean_availability_probability", "mean_availability_probability"), ("minutes_weighted_availability", "minutes_weighted_availability")):
        reasons = [F.when(F.col(f"{s}.{m}").isNull(), F.col(f"{s}.why")) for s in ("home", "away")]
        feats.append(difference(f"squad.{name}_diff_home_minus_away", F.col(f"home.{m}"), F.col(f"away.{m}"), *reasons, lineage=both))
    return explode_features(p, feats)


def manual_violations(rows: DataFrame) -> DataFrame:
    """Manual inputs with the rules they break: field, whole counts, bounds, notes and identity."""
    value, name = F.col("value"), F.col("field")
    low, high = F.lit(0.0), F.lit(1.0)
    for f, (lo, hi) in MANUAL_BOUNDS.items():
        low = F.when(name == f, F.lit(float(lo))).otherwise(low)
        high = F.when(name == f, F.lit(float(hi))).otherwise(high)
    counts = name.isin(*MANUAL_COUNTS)
    return rows.withColumn("violations", compact_codes({
        "unsupported_field": ~name.isin(*MANUAL_FIELDS),
        "not_finite": value.isNull() | F.isnan(value),
        "not_a_count": counts & ((value < 0) | (value != F.floor(value))),
        "out_of_bounds": ~counts & ((value < low) | (value > high)),
        "legal_notes_missing": F.coalesce(F.trim("legal_use_notes"), F.lit("")) == "",
        "record_id_missing": F.col("record_id").isNull(),
    }))


def manual_latest(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    """Latest usable value per (match, side, field): published by the cutoff, not post-match, no broken rule."""
    clean = manual_violations(rows).filter(F.size("violations") == 0)
    joined = clean.join(contexts.select("match_id", "prediction_time", F.col("kickoff_at")), "match_id")
    usable = joined.filter(
        F.col("available_at").isNotNull() & (F.col("available_at") <= F.col("prediction_time"))
        & (F.col("leakage_risk") != "post_match_only")
        & (F.col("kickoff_at").isNull() | (F.col("prediction_time") <= F.col("kickoff_at"))))
    return A.latest_per(usable, ["match_id", "side", "field"], ["available_at", "record_id", "value"])


def manual_features(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    """All declared manual fields of both sides; what nobody declared stays missing."""
    latest = manual_latest(contexts, rows)
    per_match = latest.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "side", "field").alias("k"), F.struct("value", "record_id").alias("v")))).alias("m"))
    wide = contexts.select("match_id", "prediction_time").join(per_match, "match_id", "left")
    feats = []
    for s in ("home", "away"):
        for f in MANUAL_FIELDS:
            got = F.try_element_at("m", F.lit(f"{s}.{f}"))
            feats.append(feature(f"manual.{s}.{f}", got["value"], F.lit(A.UPSTREAM), text_array(got["record_id"])))
    return explode_features(wide, feats)


def competition_codes(competitions: DataFrame) -> DataFrame:
    """Nominal code per catalog id, counted from zero in sorted order. The input is the catalog, one row per id."""
    return competitions.select("competition_id").distinct().withColumn(
        "competition_code", (F.row_number().over(Window.orderBy("competition_id")) - 1).cast("double"))


def confederation_pairs(contexts: DataFrame, releases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordered pair code 1..36 from memberships as published by the cutoff; 0 when a side is unknown."""
    rows = A.interval_as_of(sides(contexts, ["prediction_time", "match_date"]), releases, ["team_id"], "match_date",
                            "prediction_time", "member", hot_rows)
    p = pair_sides(rows, ["member", "member_release"], ["prediction_time", "match_date"])
    listed = F.array(*[F.lit(c) for c in CONFEDERATIONS])
    h, a = F.array_position(listed, F.col("home.member")), F.array_position(listed, F.col("away.member"))
    code = F.when((h > 0) & (a > 0), (h - 1) * len(CONFEDERATIONS) + a).otherwise(F.lit(0))
    return p.select("match_id", "prediction_time", "match_date", F.col("home.member").alias("home_member"),
                    F.col("away.member").alias("away_member"), F.coalesce(code, F.lit(0)).cast("double").alias("pair_code"))


# ---- flat availability and market tables -----------------------------------------------------------

def team_availability(players: DataFrame) -> DataFrame:
    """Value and minutes available per team from player statuses. players: team, player_id, status_text, importance, minutes."""
    weight = availability_weight("status_text")
    importance = F.greatest(F.coalesce("importance", F.lit(0.0)), F.lit(0.0))
    minutes = F.least(F.greatest(F.coalesce("minutes", F.lit(0.0)), F.lit(0.0)), F.lit(120.0))
    rows = players.select("team", "player_id", weight.alias("w"), (importance * minutes / 90.0).alias("base"), minutes.alias("min"))
    agg = rows.groupBy("team").agg(
        F.count("player_id").alias("player_count"), F.count_if(F.col("w") >= 0.75).alias("available_player_count"),
        F.count_if(F.col("w") <= 0.05).alias("unavailable_player_count"), F.sum("min").alias("expected_minutes_total"),
        F.sum(F.col("min") * F.col("w")).alias("expected_minutes_available"), F.sum("base").alias("baseline_player_value"),
        F.sum(F.col("base") * F.col("w")).alias("available_player_value"),
        F.sum(F.col("base") - F.col("base") * F.col("w")).alias("unavailable_player_value"))
    base = F.nullif(F.col("baseline_player_value"), F.lit(0.0))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), base), F.lit(0.0))
    return agg.withColumn("availability_pct", share("available_player_value")).withColumn(
        "unavailable_value_pct", share("unavailable_player_value"))


def fixture_availability(fixtures: DataFrame, team_table: DataFrame) -> DataFrame:
    """Both sides' availability on fixtures (home_team, away_team), with defaults for unknown teams."""
    out = fixtures
    for side in ("home", "away"):
        part = team_table.select(F.col("team").alias(f"{side}_team"), F.col("availability_pct").alias(f"{side}_availability_pct"),
                                 F.col("unavailable_value_pct").alias(f"{side}_unavailable_value_pct"))
        out = out.join(part, f"{side}_team", "left")
    out = out.fillna(1.0, ["home_availability_pct", "away_availability_pct"]).fillna(
        0.0, ["home_unavailable_value_pct", "away_unavailable_value_pct"])
    return out.withColumn("availability_pct_diff", F.col("home_availability_pct") - F.col("away_availability_pct")).withColumn(
        "unavailable_value_pct_diff", F.col("home_unavailable_value_pct") - F.col("away_unavailable_value_pct"))


def availability_adjustment(forecasts: DataFrame, team_table: DataFrame, strength: float = 0.10, max_shift: float = 0.08) -> DataFrame:
    """Bounded shift of the home and away probabilities by availability, floored and renormalised."""
    out = fixture_availability(forecasts, team_table)
    raw = strength * F.col("availability_pct_diff") - 0.5 * strength * F.col("unavailable_value_pct_diff")
    out = out.withColumn("shift", F.least(F.greatest(raw, F.lit(-max_shift)), F.lit(max_shift)))
    floor = lambda c: F.greatest(c, F.lit(0.01))
    h, d, a = P.triple()
    probs = P.renormalise(floor(h + F.col("shift")), floor(d), floor(a - F.col("shift")))
    for name, value in zip(("home", "draw", "away"), probs):
        out = out.withColumn(f"adjusted_{name}", value)
    adjusted = P.triple("adjusted_")
    return (
        out.withColumn("adjusted_outcome", P.argmax_outcome(*adjusted))
        .withColumn("adjusted_winner", P.winner_name("adjusted_outcome", F.col("home_team"), F.col("away_team")))
        .withColumn("adjusted_confidence", F.greatest(*adjusted))
        .withColumn("adjustment_applied", F.col("shift") != 0)
    )


def market_movement(snapshots: DataFrame, tie: list[str]) -> DataFrame:
    """Opening against latest odds and implied probabilities per fixture (fixture_id, available_at, *_odds)."""
    odds = ["home_odds", "draw_odds", "away_odds"]
    out = A.first_and_last(snapshots, ["fixture_id"], ["available_at", *tie], ["available_at", *odds], [F.count("*").alias("snapshot_count")])
    moves = {}
    for o in ("home", "draw", "away"):
        first, last = F.col(f"opening.{o}_odds"), F.col(f"latest.{o}_odds")
        moves[o] = P.implied_probability(last) - P.implied_probability(first)
        out = out.withColumn(f"{o}_odds_move", last - first).withColumn(f"{o}_implied_move", moves[o])
    size = [F.abs(F.col(f"{o}_implied_move")) for o in ("home", "draw", "away")]
    largest = F.when((size[0] >= size[1]) & (size[0] >= size[2]), F.lit("home")).when(size[1] >= size[2], F.lit("draw")).otherwise(F.lit("away"))
    out = out.withColumn("largest_outcome", largest)
    move = F.when(F.col("largest_outcome") == "home", F.col("home_implied_move")).when(
        F.col("largest_outcome") == "draw", F.col("draw_implied_move")).otherwise(F.col("away_implied_move"))
    return out.withColumn("largest_move", move).withColumn("market_direction", P.market_direction(F.col("largest_outcome"), F.col("largest_move")))
