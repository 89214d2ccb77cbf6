"""Scoring, calibration, folds, comparison, slices, drift and benchmarks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import probability as P
from ..functions.common import OUTCOMES, compact_codes
from .asof import interval_as_of
from .features import pair_sides, sides
from .quantiles import exact_quantiles, order_statistics

METRICS = ("accuracy", "log_loss", "brier", "rps")


def metrics(predictions: DataFrame, by: list[str] = (), prefix: str = "p_") -> DataFrame:
    """Accuracy, log loss, Brier and ranked probability score in one pass over any grouping."""
    row = P.metric_row("actual", *P.triple(prefix))
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in row.items()])


# ---- calibration -----------------------------------------------------------------------------------

def one_vs_rest(predictions: DataFrame, by: list[str], prefix: str = "p_") -> DataFrame:
    h, d, a = P.triple(prefix)
    rows = F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), p.alias("p"), (F.col("actual") == o).cast("double").alias("y"))
        for o, p in zip(OUTCOMES, (h, d, a))]))
    return predictions.select(*by, rows)


def bin_index(p: Column, n_bins: int, closed: str = "left") -> Column:
    """Equal-width bin of a probability; ``left`` keeps the lower edge inside, ``right`` the upper one."""
    if closed == "left":
        return F.least(F.floor(p * n_bins), F.lit(n_bins - 1)).cast("int")
    return F.greatest(F.ceil(p * n_bins) - 1, F.lit(0)).cast("int")


def calibration_bins(predictions: DataFrame, n_bins: int = 10, by: list[str] = (), closed: str = "left", prefix: str = "p_") -> DataFrame:
    """Reliability table with empty bins kept. Counts per bin are combined map-side; groups stay tiny."""
    by = list(by)
    counted = one_vs_rest(predictions, by, prefix).groupBy(*by, "outcome", bin_index(F.col("p"), n_bins, closed).alias("bin")).agg(
        F.count("*").alias("count"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"))
    stat = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("count", "sum_p", "sum_y"))))  # n_bins entries at most
    packed = counted.groupBy(*by, "outcome").agg(stat.alias("m"))
    out = packed.select(*by, "outcome", "m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = out.withColumn("s", F.try_element_at("m", F.col("bin")))
    n = F.col("s.count")
    return out.select(
        *by, "outcome", "bin", (F.col("bin") / n_bins).alias("lower"), ((F.col("bin") + 1) / n_bins).alias("upper"),
        F.coalesce(n, F.lit(0)).alias("count"), (F.col("s.sum_p") / n).alias("mean_forecast"), (F.col("s.sum_y") / n).alias("observed"),
        (F.col("s.sum_y") / n - F.col("s.sum_p") / n).alias("error"))


def calibration_summary(bins: DataFrame, by: list[str] = ()) -> DataFrame:
    """Expected and maximum error, bias per outcome, and the mean of the three expected errors."""
    by = list(by)
    total = F.sum("count")
    out = bins.groupBy(*by, "outcome").agg(
        total.alias("n"), (F.sum(F.col("count") * F.abs("error")) / total).alias("ece"), F.max(F.abs("error")).alias("max_error"),
        (F.sum(F.col("count") * F.col("error")) / total).alias("bias"))
    return out.withColumn("macro_ece", F.avg("ece").over(Window.partitionBy(*by)))


# ---- folds -----------------------------------------------------------------------------------------

def fold_table(cutoffs: list[str], evaluation_days: int, training_days: int | None = None) -> list[dict]:
    """Declared folds; a training window makes them rolling, none makes them expanding."""
    out = []
    for text in cutoffs:
        cut = dt.datetime.fromisoformat(text)
        out.append({"fold_id": text, "cutoff": cut, "end": cut + dt.timedelta(days=evaluation_days),
                    "start": cut - dt.timedelta(days=training_days) if training_days else None})
    return out


def _fold_array(folds: list[dict]) -> Column:
    ts = lambda v: F.lit(None if v is None else v.isoformat(sep=" ")).cast("timestamp")
    return F.array(*[F.struct(F.lit(f["fold_id"]).alias("fold_id"), ts(f["cutoff"]).alias("cutoff"), ts(f["end"]).alias("fold_end"),
                              ts(f["start"]).alias("train_start")) for f in folds])


def assign_folds(examples: DataFrame, folds: list[dict]) -> DataFrame:
    """Each example once per fold it takes part in, with role train, test or waiting.

    The folds travel as a literal array, so this is a map over the examples: no join and no shuffle.
    ``waiting`` marks rows old enough for training whose target was not known at the cutoff.
    """
    t, known = F.col("prediction_time"), F.col("target_available_at")

    def role(f) -> Column:
        past = (t < f["cutoff"]) & (f["train_start"].isNull() | (t >= f["train_start"]))
        return (
            F.when(past & (known <= f["cutoff"]), F.lit("train")).when(past, F.lit("waiting"))
            .when((t >= f["cutoff"]) & (t < f["fold_end"]), F.lit("test")))

    tagged = F.transform(_fold_array(folds), lambda f: F.struct(f["fold_id"].alias("fold_id"), f["cutoff"].alias("cutoff"), role(f).alias("role")))
    return examples.select("*", F.inline(F.filter(tagged, lambda x: x["role"].isNotNull())))


def fold_report(examples: DataFrame, folds: list[dict], min_train: int) -> DataFrame:
    """Counts per declared fold and the reason for skipping it, if any."""
    assigned = assign_folds(examples, folds).groupBy("fold_id").agg(*[
        F.count_if(F.col("role") == r).alias(c) for r, c in (("train", "train_count"), ("test", "test_count"), ("waiting", "unavailable_targets"))])
    declared = examples.sparkSession.createDataFrame([(f["fold_id"],) for f in folds], "fold_id STRING")
    out = declared.join(assigned, "fold_id", "left").fillna(0)
    few = F.col("train_count") < min_train
    enough_rows = F.col("train_count") + F.col("unavailable_targets") >= min_train
    reason = (
        F.when(few & enough_rows & (F.col("unavailable_targets") > 0), F.lit("insufficient_available_targets"))
        .when(few, F.lit("insufficient_training_examples"))
        .when(F.col("test_count") == 0, F.lit("empty_evaluation_window")))
    return out.withColumn("skip_reason", reason)


def fold_leaks(assigned: DataFrame) -> DataFrame:
    """Rows of an assignment (possibly made elsewhere) that break the fold rules."""
    train, test = F.col("role") == "train", F.col("role") == "test"
    w = assigned.groupBy("fold_id", "match_id").agg(F.count_distinct("role").alias("roles"))
    checked = assigned.join(w, ["fold_id", "match_id"])
    codes = compact_codes({
        "in_train_and_test": F.col("roles") > 1,
        "train_after_cutoff": train & (F.col("prediction_time") >= F.col("cutoff")),
        "target_unavailable": train & (F.col("target_available_at") > F.col("cutoff")),
        "test_before_cutoff": test & (F.col("prediction_time") < F.col("cutoff")),
    })
    return checked.withColumn("violations", codes).filter(F.size("violations") > 0).drop("roles")


def date_split(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    return df.withColumn("role", F.when(F.col(date) < F.lit(cutoff).cast("date"), F.lit("train")).otherwise(F.lit("test")))


def chronological_split(df: DataFrame, date: str, tie: str, test_fraction: float = 0.2) -> DataFrame:
    """First rows by (date, tie) train, the rest test, cut at an exact rank.

    The boundary date comes from per-date counts and the boundary tie value from exact order
    statistics inside that date; a few numbers reach the driver and no global sort is made.
    """
    daily = df.groupBy(date).agg(F.count("*").alias("n"))
    running = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("through", F.sum("n").over(running))  # one row per calendar day
    total = df.count()
    train = int(total * (1.0 - test_fraction))
    edge = daily.filter(F.col("through") >= train).orderBy(date).first()
    day, need = edge[date], train - (edge["through"] - edge["n"])
    same = F.col(date) == F.lit(day)
    inside = F.lit(False)
    if need > 0:
        one = df.filter(same).withColumn("__k", F.lit("d"))
        rank = need - 1
        bound = order_statistics(one, "__k", tie, lambda n: F.array(F.lit(rank).cast("long"))).first()[tie]
        inside = F.col(tie) <= F.lit(bound)
    return df.withColumn("role", F.when((F.col(date) < F.lit(day)) | (same & inside), F.lit("train")).otherwise(F.lit("test")))


# ---- comparison ------------------------------------------------------------------------------------

def unpaired(runs: DataFrame, run: str, key: str, identity: list[str]) -> DataFrame:
    """Samples that not every run has exactly once with the same identity. One aggregate, no pairing join."""
    expected = runs.agg(F.count_distinct(run)).scalar()
    packed = F.struct(*identity)
    per = runs.groupBy(key).agg(F.count("*").alias("copies"), F.count_distinct(run).alias("runs"), F.min(packed).alias("lo"), F.max(packed).alias("hi"))
    codes = compact_codes({"missing_in_a_run": F.col("runs") < expected, "repeated": F.col("copies") > F.col("runs"), "identity_differs": F.col("lo") != F.col("hi")})
    return per.withColumn("problems", codes).filter(F.size("problems") > 0).select(key, "problems")


def compare_runs(runs: DataFrame, run: str, reference: str) -> DataFrame:
    """Metrics per run and their differences to the reference run (runs are few)."""
    m = metrics(runs, [run])
    base = m.filter(F.col(run) == reference)
    return m.select("*", *[(F.col(c) - base.select(c).scalar()).alias(f"{c}_delta") for c in ("log_loss", "brier", "rps")])


def block_sums(paired: DataFrame, block_days: int = 30) -> DataFrame:
    """Loss differences (q minus p) summed per calendar block."""
    a, b = (P.metric_row("actual", *P.triple(x)) for x in ("p_", "q_"))
    block = F.floor(F.unix_date(F.to_date("prediction_time")) / block_days).alias("block")
    return paired.groupBy(block).agg(F.count("*").alias("n"), *[F.sum(b[m] - a[m]).alias(m) for m in ("log_loss", "brier", "rps")])


def block_bootstrap(blocks: DataFrame, repetitions: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile intervals from resampled blocks; draws come from a hash, so any partitioning repeats them.

    Work is repetitions x blocks, both bounded (blocks by the calendar), whatever the number of rows.
    """
    spark = blocks.sparkSession
    numbered = blocks.withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)
    count = blocks.agg(F.count("*")).scalar()
    reps = spark.range(repetitions).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("draw"), count.alias("b"))
    draws = reps.select("rep", F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col("draw")), F.col("b")).cast("int").alias("i"))
    names = ("log_loss", "brier", "rps")
    est = draws.join(F.broadcast(numbered), "i").groupBy("rep").agg(*[(F.sum(m) / F.sum("n")).alias(m) for m in names])
    wide = est.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in names])
    point = blocks.agg(F.count("*").alias("blocks"), *[(F.sum(m) / F.sum("n")).alias(f"d_{m}") for m in names])
    both = point.withColumns({m: wide.select(m).scalar() for m in names})
    enough = F.col("blocks") >= 4
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"d_{m}").alias("delta"), F.when(enough, F.col(m)[0]).alias("lower"),
                 F.when(enough, F.col(m)[1]).alias("upper"), F.when(enough, F.lit("estimated")).otherwise(F.lit("insufficient_blocks")).alias("status"))
        for m in names]))
    return both.select("blocks", rows)


# ---- market benchmark ------------------------------------------------------------------------------

def market_quotes(predictions: DataFrame, quotes: DataFrame, timing: str = "prediction_time") -> DataFrame:
    """Per (match, bookmaker) the quote a benchmark uses. predictions: match_id, prediction_time, kickoff_at."""
    cutoff = F.col("prediction_time") if timing == "prediction_time" else F.col("kickoff_at")
    joined = quotes.join(predictions.select("match_id", cutoff.alias("cutoff")).filter("cutoff IS NOT NULL"), "match_id")
    seen = joined.filter(F.col("available_at").isNotNull() & (F.col("available_at") <= F.col("cutoff")))
    packed = F.struct("available_at", "record_id", "home_odds", "draw_odds", "away_odds")
    pick = F.min_by if timing == "opening" else F.max_by
    chosen = seen.groupBy("match_id", "bookmaker").agg(pick(packed, F.struct("available_at", "record_id")).alias("q"))
    return chosen.withColumn("fair", P.devig(F.col("q.home_odds"), F.col("q.draw_odds"), F.col("q.away_odds")))


def market_benchmark(predictions: DataFrame, quotes: DataFrame, timing: str = "prediction_time") -> DataFrame:
    """Model and market log loss per match, or the reason it was excluded."""
    chosen = market_quotes(predictions, quotes, timing)
    consensus = chosen.groupBy("match_id").agg(
        F.count("*").alias("bookmakers"), *[F.avg(f"fair.{o}").alias(f"m_{o}") for o in ("home", "draw", "away")])
    out = predictions.join(consensus, "match_id", "left")
    no_kickoff = F.lit(timing != "prediction_time") & F.col("kickoff_at").isNull()
    reason = F.when(no_kickoff, F.lit("unknown_exact_kickoff")).when(F.col("bookmakers").isNull(), F.lit("no_eligible_market_snapshot"))
    return (
        out.withColumn("excluded_reason", reason)
        .withColumn("model_log_loss", F.when(reason.isNull(), P.log_loss("actual", *P.triple())))
        .withColumn("market_log_loss", F.when(reason.isNull(), P.log_loss("actual", *P.triple("m_")))))


def benchmark_summary(benchmark: DataFrame) -> DataFrame:
    used = F.col("excluded_reason").isNull()
    return benchmark.agg(
        F.count("*").alias("total_predictions"), F.count_if(used).alias("matched_predictions"),
        F.avg(used.cast("double")).alias("coverage"), F.avg(F.col("model_log_loss") - F.col("market_log_loss")).alias("mean_log_loss_delta_vs_market"))


def timing_comparison(opening: DataFrame, closing: DataFrame) -> DataFrame:
    """Opening against closing quote of the same match and bookmaker; unpaired ones are kept and marked."""
    o = opening.select("match_id", "bookmaker", F.col("q.available_at").alias("o_at"), F.col("fair").alias("o"))
    c = closing.select("match_id", "bookmaker", F.col("q.available_at").alias("c_at"), F.col("fair").alias("c"))
    j = o.join(c, ["match_id", "bookmaker"], "full_outer")
    side = F.when(F.col("o").isNull(), F.lit("closing_only")).when(F.col("c").isNull(), F.lit("opening_only")).otherwise(F.lit("paired"))
    return j.select("match_id", "bookmaker", side.alias("pairing"), (F.col("o_at") != F.col("c_at")).alias("distinct_publications"),
                    *[(F.col(f"c.{x}") - F.col(f"o.{x}")).alias(f"{x}_change") for x in ("home", "draw", "away")])


# ---- diagnostics and slices ------------------------------------------------------------------------

def diagnostics(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Predictions verified against canonical results, with per-row metrics and a violations array.

    predictions: match_id, prediction_time, cutoff, actual, p_*; matches: scores and eligible_at.
    """
    canon = matches.select("match_id", "match_date", "competition_id", "neutral", "home_id", "away_id", "home_score", "away_score",
                           "kickoff_at", "eligible_at", F.lit(True).alias("__found"))
    j = predictions.join(canon, "match_id", "left")
    canonical = P.outcome_label("home_score", "away_score")
    late = F.col("prediction_time") > F.col("kickoff_at")
    same_day = F.col("kickoff_at").isNull() & (F.to_date("prediction_time") >= F.col("match_date"))
    found = F.col("__found").isNotNull()
    codes = compact_codes({
        "missing_match": ~found,
        "no_eligible_result": found & F.col("eligible_at").isNull(),
        "target_conflict": found & canonical.isNotNull() & (canonical != F.col("actual")),
        "prediction_before_cutoff": F.col("prediction_time") < F.col("cutoff"),
        "prediction_not_before_match": found & (F.coalesce(late, F.lit(False)) | same_day),
        "target_known_at_prediction": F.col("eligible_at") <= F.col("prediction_time"),
    })
    probs = P.triple()
    out = j.withColumn("violations", codes).withColumn("predicted", P.argmax_outcome(*probs)).withColumn(
        "p_actual", P.pick("actual", *probs)).withColumn("entropy", P.entropy_nats(*probs))
    return out.withColumns(P.metric_row("actual", *probs)).drop("__found")


def slices(rows: DataFrame, dimensions: dict[str, Column], min_sample: int = 30) -> DataFrame:
    """Metrics per (dimension, key); a dimension given as an array puts a row into several keys."""
    def tags(name: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("dimension"), k.cast("string").alias("key")))

    entries = [tags(name, keys) for name, keys in dimensions.items()]
    tagged = rows.select(*METRICS, "actual", F.inline(F.flatten(F.array(*entries))))
    return tagged.groupBy("dimension", "key").agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS],
        *[F.count_if(F.col("actual") == o).alias(f"{o}_count") for o in OUTCOMES],
    ).withColumn("below_minimum", F.col("n") < min_sample)


def standard_dimensions() -> dict[str, Column]:
    return {
        "competition": F.array("competition_id"),
        "year": F.array(F.date_format("match_date", "yyyy")),
        "venue": F.array(F.when(F.col("neutral"), F.lit("neutral")).otherwise(F.lit("home"))),
        "team": F.array("home_id", "away_id"),
    }


def with_memberships(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """Home and away membership as published at each row's prediction time, ``unknown`` where there is none."""
    keep = ["prediction_time", "match_date"]
    r = interval_as_of(sides(rows, keep), releases, ["team_id"], "match_date", "prediction_time", "member")
    p = pair_sides(r, ["member"], keep).select("match_id", *[F.coalesce(F.col(f"{s}.member"), F.lit("unknown")).alias(f"{s}_member") for s in ("home", "away")])
    return rows.join(p, "match_id")


def membership_dimensions() -> dict[str, Column]:
    return {"home_confederation": F.array("home_member"), "away_confederation": F.array("away_member"),
            "confederation_pair": F.array(F.concat_ws("/", "home_member", "away_member"))}


# ---- drift -----------------------------------------------------------------------------------------

def feature_drift(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """PSI over reference quantile bins, means and the share outside the reference range, per feature.

    Inputs are long (feature, value). Quantiles are exact and distributed; histograms are partial
    counts, so no feature's values are gathered.
    """
    edges = exact_quantiles(reference, "feature", "value", [i / bins for i in range(1, bins)])
    edges = edges.select("feature", F.array_sort(F.array_distinct("quantiles")).alias("edges"))
    stats = reference.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("reference_mean"))
    known = edges.join(stats, "feature")  # one row per feature
    both = reference.select("feature", "value", F.lit("r").alias("part")).unionByName(current.select("feature", "value", F.lit("c").alias("part")))
    # right-open bins: the bin of a value is the number of edges at or below it
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    binned = both.join(F.broadcast(known), "feature").withColumn("bin", place)  # a shuffle by feature would bring all rows of one to a task
    ref = F.col("part") == "r"
    outside = ~ref & ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    counts = binned.groupBy("feature", "bin").agg(
        F.count_if(ref).alias("r"), F.count_if(~ref).alias("c"), F.count_if(outside).alias("out"),
        F.sum(F.when(~ref, F.col("value"))).alias("cs"), F.first("reference_mean").alias("reference_mean"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.first(F.size("edges")).alias("ne"))
    per = counts.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("m"), F.sum("r").alias("nr"), F.sum("c").alias("nc"),
        F.sum("out").alias("out"), F.sum("cs").alias("cs"), F.first("reference_mean").alias("reference_mean"), F.first("lo").alias("reference_min"),
        F.first("hi").alias("reference_max"), F.first("ne").alias("ne"))
    all_bins = F.sequence(F.lit(0), F.col("ne"))
    share = lambda field, total: F.transform(all_bins, lambda b: F.greatest(
        F.coalesce(F.try_element_at("m", b)[field], F.lit(0)) / F.col(total), F.lit(1e-6)))
    per = per.withColumn("p", share("r", "nr")).withColumn("q", share("c", "nc"))
    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    per = per.withColumn("p", norm(F.col("p"))).withColumn("q", norm(F.col("q")))
    psi = F.aggregate(F.zip_with("p", "q", lambda p, q: (q - p) * F.ln(q / p)), F.lit(0.0), lambda s, x: s + x)
    return per.select("feature", psi.alias("psi"), "reference_mean", (F.col("cs") / F.col("nc")).alias("current_mean"), "reference_min", "reference_max",
                      (F.col("out") / F.col("nc")).alias("outside_reference_range"))


# ---- run records -----------------------------------------------------------------------------------

def manifest(fold_metrics: DataFrame, run: list[str], details: dict[str, str]) -> DataFrame:
    """One row per run: folds in order with their ids and metrics, and the content id of all of it."""
    folds = F.array_sort(F.collect_list(F.struct("fold_id", "model_id", "n", *METRICS)))  # folds per run are declared, hence few
    out = fold_metrics.groupBy(*run).agg(folds.alias("folds"), F.sum("n").alias("prediction_count"))
    for name, value in details.items():
        out = out.withColumn(name, F.lit(value))
    body = F.to_json(F.struct(*run, F.transform("folds", lambda f: F.struct(f["fold_id"], f["model_id"], f["n"])), *details))
    return out.withColumn("experiment_id", F.concat(F.lit("experiment_"), F.sha2(body, 256)))


def evidence_mismatches(claims: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Claimed metrics that do not reproduce: (keys, metric, claimed, actual), missing rows included."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cast = df.select(*keys, *[F.col(m).cast("double") for m in ("n", *METRICS)])
        return cast.unpivot(keys, ["n", *METRICS], "metric", name)

    j = long(claims, "claimed").join(long(recomputed, "actual"), [*keys, "metric"], "full_outer")
    same = F.col("claimed").isNotNull() & F.col("actual").isNotNull() & (F.abs(F.col("claimed") - F.col("actual")) <= tolerance)
    return j.filter(~same)


def uncovered(required: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Serving models for which no evaluated run exists."""
    return required.join(evidence.select(*keys).distinct(), keys, "left_anti")


def summarise_backtests(fold_metrics: DataFrame, model: str) -> DataFrame:
    """Mean metrics per model over its folds, best log loss first."""
    return fold_metrics.groupBy(model).agg(
        F.count("*").alias("folds"), F.sum("n").alias("test_rows"), *[F.avg(m).alias(f"mean_{m}") for m in METRICS]).orderBy("mean_log_loss", model)

