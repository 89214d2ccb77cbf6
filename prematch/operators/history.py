"""Result eligibility, prediction cutoffs and team history as of a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import micros
from .skew import HOT_ROWS, running_top_n


def with_eligibility(matches: DataFrame) -> DataFrame:
    """Add eligible_at, eligibility_basis and eligibility_violation to completed matches.

    A known kickoff needs a source time after it, else the next UTC midnight applies when no source
    time exists. A date-only match becomes usable at the later of source time and next midnight.
    """
    known = F.col("kickoff_at").isNotNull()
    source = F.col("available_at")
    day = F.when(known, F.to_date("kickoff_at")).otherwise(F.col("match_date"))
    midnight = F.date_add(day, 1).cast("timestamp")
    violation = F.when(known & (source <= F.col("kickoff_at")), F.lit("available_not_after_kickoff")).when(
        ~known & (F.to_date(source) < F.col("match_date")), F.lit("available_before_match_date")
    )
    use_source = source.isNotNull() & (known | (source > midnight))
    eligible = F.when(use_source, source).otherwise(midnight)
    basis = F.when(use_source, F.lit("source_available_at")).otherwise(F.lit("conservative_next_utc_day"))
    completed = (F.col("status") == "completed") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    ok = completed & violation.isNull()
    return (
        matches.withColumn("eligible_at", F.when(ok, eligible))
        .withColumn("eligibility_basis", F.when(ok, basis))
        .withColumn("eligibility_violation", F.when(completed, violation))
    )


def eligible_before(matches: DataFrame, cutoff: Column | str) -> DataFrame:
    """Completed results usable at a cutoff (a literal timestamp text or a column)."""
    limit = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    return matches.filter(F.col("eligible_at") <= limit)


def with_cutoff(matches: DataFrame, lead_minutes: int = 0, date_only_lead_days: int = 1) -> DataFrame:
    """Add prediction_time: kickoff minus the lead, or the last microsecond of an earlier day."""
    exact = F.col("kickoff_at") - F.expr(f"INTERVAL {int(lead_minutes)} MINUTE")
    end_of_day = F.date_sub("match_date", date_only_lead_days - 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    return matches.withColumn("prediction_time", F.when(F.col("kickoff_at").isNotNull(), exact).otherwise(end_of_day))


def team_rows(matches: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Two rows per match, one from each side's view, from a single scan."""
    def side(name: str, own: str, other: str) -> Column:
        return F.struct(
            F.lit(name).alias("side"), F.col(f"{own}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"),
            F.col(f"{own}_score").alias("goals_for"), F.col(f"{other}_score").alias("goals_against"),
        )

    sides = F.explode(F.array(side("home", "home", "away"), side("away", "away", "home")))
    rows = matches.select("match_id", "match_date", "kickoff_at", *keep, sides.alias("__s"))
    return rows.select("match_id", "match_date", "kickoff_at", *keep, "__s.*").withColumn(
        "points",
        F.when(F.col("goals_for") > F.col("goals_against"), F.lit(3))
        .when(F.col("goals_for") == F.col("goals_against"), F.lit(1))
        .when(F.col("goals_for") < F.col("goals_against"), F.lit(0)),
    )


def history_entry() -> Column:
    """Sortable struct of one past match: its leading fields are the history order."""
    return F.struct(
        F.col("match_date").alias("d"), F.col("kickoff_at").isNull().alias("k0"), F.col("kickoff_at").alias("k"),
        F.col("match_id").alias("m"), F.col("points").cast("int").alias("pts"),
        F.col("goals_for").cast("int").alias("gf"), F.col("goals_against").cast("int").alias("ga"),
    )


def recent_history(matches: DataFrame, depth: int, targets: DataFrame | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """For every (match, side): the last ``depth`` results of that team eligible at the match's cutoff.

    matches carry eligible_at and prediction_time. Results may become eligible out of match order, so
    the state is a running top-n over one time-ordered union of results (at eligible_at) and readers
    (at prediction_time); a result available exactly at the cutoff is included. ``history`` is newest
    first.
    """
    entry_time = [micros("eligible_at").alias("__t"), F.lit(0).alias("__reader")]
    results = team_rows(matches.filter(F.col("eligible_at").isNotNull()), ["eligible_at"]).select(
        "team_id", *entry_time, history_entry().alias("__v"),
        F.lit(None).cast(matches.schema["match_id"].dataType).alias("match_id"), F.lit(None).cast("string").alias("side"),
    )
    readers = team_rows(targets if targets is not None else matches, ["prediction_time"]).select(
        "team_id", micros("prediction_time").alias("__t"), F.lit(1).alias("__reader"),
        F.lit(None).cast(results.schema["__v"].dataType).alias("__v"), "match_id", "side",
    )
    ranked = running_top_n(results.unionByName(readers), ["team_id"], ["__t", "__reader"], "__v", depth,
                           F.col("__t"), "history", hot_rows, F.col("__reader") == 1)
    return ranked.select("match_id", "side", "team_id", "history")
