"""Operational tables over stored matches and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import probability as P
from ..functions import strength as S
from ..functions.common import compact_codes
from .asof import is_safe, latest_per
from .history import team_rows
from .ratings import glicko_expectation

# Watch rule of the residual signal.
WATCH_WINDOW, WATCH_MINIMUM, WATCH_THRESHOLD = 10, 5, 1.5


def batch_statuses(fixtures: DataFrame, now: str, from_date: str, through_date: str) -> DataFrame:
    """Status of every fixture in a date window; one failure withholds all forecasts of the batch.

    fixtures carry status, kickoff_at, match_date and the probabilities p_* (null when the forecast failed).
    """
    moment = F.lit(now).cast("timestamp")
    window = F.col("match_date").between(F.lit(from_date).cast("date"), F.lit(through_date).cast("date"))
    closed = F.coalesce(F.col("kickoff_at") <= moment, F.col("match_date") <= moment.cast("date"))
    status = (
        F.when(F.col("status") != "scheduled", F.struct(F.lit("skipped").alias("s"), F.lit("not_scheduled").alias("r")))
        .when(closed, F.struct(F.lit("skipped").alias("s"), F.lit("pre_match_window_closed").alias("r")))
        .when(F.col("p_home").isNull(), F.struct(F.lit("failed").alias("s"), F.lit("no_forecast").alias("r")))
        .otherwise(F.struct(F.lit("forecasted").alias("s"), F.lit(None).cast("string").alias("r"))))
    rows = fixtures.filter(window).withColumn("__s", status)
    failed = rows.agg(F.coalesce(F.max((F.col("__s.s") == "failed").cast("int")), F.lit(0))).scalar()
    withheld = (F.col("__s.s") == "forecasted") & (failed == 1)
    return (
        rows.withColumn("batch_status", F.when(withheld, F.lit("withheld")).otherwise(F.col("__s.s")))
        .withColumn("batch_reason", F.when(withheld, F.lit("batch_failed")).otherwise(F.col("__s.r"))).drop("__s"))


def batch_counts(statuses: DataFrame) -> DataFrame:
    names = ("forecasted", "skipped", "failed", "withheld")
    return statuses.agg(*[F.count_if(F.col("batch_status") == n).alias(n) for n in names])


def attach_market(forecasts: DataFrame, quotes: DataFrame, as_of: str) -> DataFrame:
    """Model minus market from the latest safe, regulation-time quote per bookmaker known at a moment."""
    moment = F.lit(as_of).cast("timestamp")
    usable = quotes.filter(is_safe() & (F.col("score_basis") == "regulation_time") & (F.col("available_at") <= moment))
    latest = latest_per(usable, ["match_id", "bookmaker"], ["available_at", "record_id"])
    fair = latest.withColumn("f", P.devig(F.col("home_odds"), F.col("draw_odds"), F.col("away_odds")))
    consensus = fair.groupBy("match_id").agg(
        F.count("*").alias("bookmakers"), *[F.avg(f"f.{s}").alias(f"market_{s}") for s in ("home", "draw", "away")])
    joined = forecasts.join(consensus, "match_id", "left")
    return joined.withColumns({f"minus_market_{s}": F.col(f"p_{s}") - F.col(f"market_{s}") for s in ("home", "draw", "away")})


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    return latest_per(forecasts, ["match_id"], ["prediction_time", "forecast_id"])


def post_match(matches: DataFrame, forecasts: DataFrame, as_of: str) -> DataFrame:
    """Latest forecast of every settled match against its result: surprisal, residuals and miss class."""
    moment = F.lit(as_of).cast("timestamp")
    done = matches.filter(F.col("eligible_at") <= moment).select(
        "match_id", "match_date", "home_id", "away_id", P.outcome_label("home_score", "away_score").alias("actual"))
    known = latest_forecasts(forecasts.filter(F.col("prediction_time") <= moment))
    j = done.join(known, "match_id")
    probs = P.triple()
    p_actual = P.pick("actual", *probs)
    result = F.when(F.col("actual") == "home_win", 1.0).when(F.col("actual") == "draw", 0.5).otherwise(0.0)
    residual = result - (F.col("p_home") + 0.5 * F.col("p_draw"))
    return j.select(
        "match_id", "forecast_id", "match_date", "home_id", "away_id", "actual", p_actual.alias("actual_probability"),
        (-F.ln(F.greatest(p_actual, F.lit(1e-15)))).alias("surprisal_nats"), residual.alias("home_residual"), (-residual).alias("away_residual"),
        F.when(P.argmax_outcome(*probs) == F.col("actual"), F.lit("correct")).otherwise(F.lit("outcome_miss")).alias("miss_classification"))


def recent_team_rows(matches: DataFrame, as_of: str, depth: int = 20) -> DataFrame:
    """Each team's last results at a moment, numbered from the newest."""
    rows = team_rows(matches.filter(F.col("eligible_at") <= F.lit(as_of).cast("timestamp")))
    w = Window.partitionBy("team_id").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= depth)


def team_form(matches: DataFrame, as_of: str, windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Form windows of all teams at once: matches, mean points and total goal difference."""
    recent = recent_team_rows(matches, as_of, max(windows))
    aggs: list[Column] = []
    for n in windows:
        inside = F.col("rn") <= n
        aggs += [F.count_if(inside).alias(f"matches_{n}"), F.avg(F.when(inside, F.col("points"))).alias(f"points_{n}"),
                 F.sum(F.when(inside, F.col("goals_for") - F.col("goals_against"))).alias(f"goal_difference_{n}")]
    return recent.groupBy("team_id").agg(*aggs)


def schedule_strength(matches: DataFrame, history: DataFrame, as_of: str, depth: int = 20) -> DataFrame:
    """Mean opponent rating and mean score residual over each team's last matches, from states before each day."""
    recent = recent_team_rows(matches, as_of, depth)
    own = history.select("team_id", F.col("effective_date").alias("match_date"), F.col("rating_before").alias("r"), F.col("deviation_before").alias("d"))
    other = history.select(F.col("team_id").alias("opponent_id"), F.col("effective_date").alias("match_date"), F.col("rating_before").alias("o_r"), F.col("deviation_before").alias("o_d"))
    j = recent.join(own, ["team_id", "match_date"]).join(other, ["opponent_id", "match_date"])
    # both sides' deviations widen the expectation here
    _, expected = glicko_expectation(F.col("r"), F.col("o_r"), F.col("d") * F.col("d") + F.col("o_d") * F.col("o_d"))
    residual = S.actual_score(F.col("goals_for"), F.col("goals_against")) - expected
    return j.groupBy("team_id").agg(F.count("*").alias("matches"), F.avg("o_r").alias("strength_of_schedule"), F.avg(residual).alias("opponent_adjusted_residual"))


def next_matches(matches: DataFrame, forecasts: DataFrame, as_of: str) -> DataFrame:
    """Each team's next scheduled match after a day and the latest forecast for it."""
    ahead = matches.filter((F.col("status") == "scheduled") & (F.col("match_date") > F.lit(as_of).cast("date")))
    sides = ahead.select("match_id", "match_date", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    first = sides.groupBy("team_id").agg(F.min(F.struct("match_date", "match_id")).alias("m")).select("team_id", "m.match_id", "m.match_date")
    known = latest_forecasts(forecasts).select("match_id", "forecast_id")
    return first.join(known, "match_id", "left")


def watch_signals(diagnostics: DataFrame) -> DataFrame:
    """Sum of each team's last ten forecast residuals and the signal it gives."""
    sides = F.inline(F.array(*[F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"{s}_residual").alias("residual")) for s in ("home", "away")]))
    rows = diagnostics.select("match_id", "match_date", sides)
    w = Window.partitionBy("team_id").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    recent = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= WATCH_WINDOW)
    out = recent.groupBy("team_id").agg(F.count("*").alias("sample"), F.sum("residual").alias("residual_sum"))
    signal = (
        F.when(F.col("sample") < WATCH_MINIMUM, F.lit("insufficient_history"))
        .when(F.col("residual_sum") >= WATCH_THRESHOLD, F.lit("positive_residual"))
        .when(F.col("residual_sum") <= -WATCH_THRESHOLD, F.lit("negative_residual")).otherwise(F.lit("none")))
    return out.withColumn("watch_signal", signal)


def match_report(matches: DataFrame, forecasts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row per match and forecast, the forecast behind the post-match diagnostics marked.

    Rows stay long: a match with very many forecasts is never gathered into one value.
    """
    f = forecasts.select("match_id", "forecast_id", "prediction_time", *[F.col(f"p_{s}") for s in ("home", "draw", "away")])
    d = diagnostics.select("match_id", "forecast_id", "actual", "surprisal_nats", "miss_classification")
    base = matches.select("match_id", "match_date", "status", "home_id", "away_id")
    return base.join(f, "match_id", "left").join(d, ["match_id", "forecast_id"], "left").withColumn(
        "diagnosed", F.col("miss_classification").isNotNull())


def serving_gate(models: DataFrame, metrics: DataFrame, releases: DataFrame, now: str, max_age_days: int) -> DataFrame:
    """Whether a model may serve: its release names the current model and metrics revisions and its age fits.

    models: model_id, record_id, training_cutoff; metrics: model_id, record_id; releases: model_id, model_record_id, metrics_record_id.
    """
    m = models.select("model_id", F.col("record_id").alias("__m"), "training_cutoff")
    e = metrics.select("model_id", F.col("record_id").alias("__e"))
    r = releases.select("model_id", F.col("model_record_id").alias("__rm"), F.col("metrics_record_id").alias("__re"))
    j = m.join(e, "model_id", "left").join(r, "model_id", "left")
    age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("training_cutoff"))) / 86400.0
    codes = compact_codes({
        "not_released": F.col("__rm").isNull(),
        "model_changed": F.col("__rm") != F.col("__m"),
        "metrics_changed": F.col("__rm").isNotNull() & ~F.col("__re").eqNullSafe(F.col("__e")),
        "history_out_of_bounds": (age < 0) | (age > max_age_days),
    })
    return j.withColumn("age_days", age).withColumn("problems", codes).withColumn("approved", F.size("problems") == 0).drop("__m", "__e", "__rm", "__re")


def model_facts(models: DataFrame, training: DataFrame, transforms: DataFrame, releases: DataFrame) -> DataFrame:
    """Training cutoff, row count, sources, calibration and release of every model (sources per model are few)."""
    seen = training.groupBy("model_id", "source").agg(F.count("*").alias("n"))
    facts = seen.groupBy("model_id").agg(F.sum("n").alias("training_rows"), F.array_sort(F.collect_list("source")).alias("sources"))
    calibrated = transforms.select("model_id").distinct().withColumn("calibrated", F.lit(True))
    released = releases.select("model_id").distinct().withColumn("released", F.lit(True))
    out = models.join(facts, "model_id", "left").join(calibrated, "model_id", "left").join(released, "model_id", "left")
    return out.fillna(False, ["calibrated", "released"])


def with_lineage(forecasts: DataFrame, model_record: Column, metrics_record: Column, approval_record: Column, match_record: Column) -> DataFrame:
    """Forecasts with the revisions they were made from and an id over content and lineage."""
    lineage = F.struct(model_record.alias("model_record_id"), metrics_record.alias("metrics_record_id"),
                       approval_record.alias("approval_record_id"), match_record.alias("match_record_id"))
    out = forecasts.withColumn("lineage", lineage)
    body = F.to_json(F.struct("match_id", F.format_string("%.9f", F.col("p_home")).alias("p_home"), F.format_string("%.9f", F.col("p_draw")).alias("p_draw"), "lineage"))
    return out.withColumn("forecast_id", F.concat(F.lit("forecast_"), F.sha2(body, 256)))
