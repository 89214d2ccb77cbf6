"""Order-dependent rating replays.

A rating depends on every earlier result of its pool, so a pool is one chain of dependencies. Pools up
to ``POOL_ROWS`` rows, a size checked before the plan is chosen, are replayed by a grouped map, many
pools in parallel. A larger pool never enters one task: it is cut into blocks of whole days of about
``BLOCK_ROWS`` rows, which are replayed one after the other; from block to block go only the states of
the teams, as a written table. The tests compare both with a plain loop.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import strength as S
from ..functions.common import micros
from ..functions.probability import outcome_label
from ..session import ensure_checkpoint_dir
from . import skew
from .features import replay_form

POOL_ROWS = BLOCK_ROWS = 500_000
DATE_ORDER = ["match_date", "home_id", "away_id", "match_id"]
KICKOFF_ORDER = ["match_date", "kickoff_missing", "kickoff_at", "home_id", "away_id", "match_id"]
CARRIED = ["pool", "match_id", "match_date", "kickoff_at", "kickoff_missing", "home_id", "away_id", "home_score", "away_score", "neutral", "weight"]


def _prepare(matches: DataFrame, pool: Column | None) -> DataFrame:
    """Scored matches with a date; one without a date has no place in the order. A null pool is a pool of its own."""
    known = matches if "kickoff_at" in matches.columns else matches.withColumn("kickoff_at", F.lit(None).cast("timestamp"))
    return (
        known.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & F.col("match_date").isNotNull())
        .withColumn("pool", F.lit("all") if pool is None else F.coalesce(pool.cast("string"), F.lit("(none)")))
        .withColumn("kickoff_missing", F.col("kickoff_at").isNull())
        .withColumn("weight", S.importance("tournament") if "tournament" in known.columns else F.lit(1.0))
        .select(*CARRIED)
    )


def _split_pools(prepared: DataFrame, pool_rows: int) -> tuple[DataFrame | None, list[str]]:
    """Rows of the pools small enough for a grouped map, and the names of the others.

    At most rows / pool_rows names can be listed.
    """
    sizes = prepared.groupBy("pool").agg(F.count("*").alias("n"))
    large = [r["pool"] for r in sizes.filter(F.col("n") > pool_rows).select("pool").collect()]
    small = prepared.filter(~F.col("pool").isin(large)) if large else prepared
    return small, large


Replay = Callable[[pd.DataFrame, pd.DataFrame | None], tuple[pd.DataFrame, pd.DataFrame]]


def _replayed(prepared: DataFrame, replay: Replay, needs: list[str], schema: str, pool_rows: int, block_rows: int) -> DataFrame:
    """Rows (pool, *schema) of a replay of every pool.

    replay: (rows, states or None) -> (result rows, states after them), both in the columns of ``schema``.
    """
    small, large = _split_pools(prepared, pool_rows)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return replay(rows, None)[0].assign(pool=key[0])

    result = small.select("pool", *needs).groupBy("pool").applyInPandas(whole, f"{schema}, pool STRING")
    if large:
        result = result.unionByName(_replay_blocks(prepared.filter(F.col("pool").isin(large)), replay, needs, schema, block_rows))
    return result


def _replay_blocks(pools: DataFrame, replay: Replay, needs: list[str], schema: str, block_rows: int) -> DataFrame:
    """Replay of large pools block by block. A task holds a block of a pool and the states of its teams."""
    spark = pools.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/replay-{uuid.uuid4().hex}"
    earlier = Window.partitionBy("pool").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = pools.groupBy("pool", "match_date").agg(F.count("*").alias("n"))  # calendar-bounded
    blocks = days.select("pool", "match_date", F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / block_rows).cast("int").alias("__block"))
    placed = pools.select("pool", *needs, "match_date") if "match_date" not in needs else pools.select("pool", *needs)
    placed.join(F.broadcast(blocks), ["pool", "match_date"]).repartition("__block", "pool").write.partitionBy("__block").parquet(f"{folder}/input")
    stored = spark.read.parquet(f"{folder}/input")
    both = f"{schema}, pool STRING, state BOOLEAN"

    def step(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return states.assign(state=True)
        out, after = replay(rows, states)
        return pd.concat([out.assign(state=False), after.assign(state=True)]).assign(pool=key[0])

    states = spark.createDataFrame([], both)
    for number in [r[0] for r in blocks.select("__block").distinct().orderBy("__block").collect()]:  # rows / block_rows numbers
        part = stored.filter(F.col("__block") == number).select("pool", *needs)
        done = part.groupBy("pool").cogroup(states.groupBy("pool")).applyInPandas(step, both)
        done.write.partitionBy("state").parquet(f"{folder}/output/block={number}")
        states = spark.read.schema(both).parquet(f"{folder}/output/block={number}").filter("state")
    return spark.read.schema(f"{both}, block INT").parquet(f"{folder}/output").filter("NOT state").drop("state", "block")


ELO_SCHEMA = "match_id BIGINT, home_before DOUBLE, away_before DOUBLE, rating_change DOUBLE"
ELO_COLUMNS = ["match_id", "home_before", "away_before", "rating_change"]


def elo_history(matches: DataFrame, pool: Column | None = None, order: list[str] = DATE_ORDER, k: float = S.ELO_K,
                advantage: float = S.ELO_HOME_ADVANTAGE, start: float = S.ELO_START, pool_rows: int = POOL_ROWS,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Match-level Elo history: ratings before and after, expected scores, change. ``order`` starts with match_date."""
    prepared = _prepare(matches, pool)
    needs = list(dict.fromkeys([*order, "match_id", "home_id", "away_id", "home_score", "away_score", "neutral", "weight"]))
    core = _replayed(prepared, _elo_replay(order, k, advantage, start), needs, ELO_SCHEMA, pool_rows, block_rows)
    joined = prepared.join(core, ["pool", "match_id"])
    adjusted = F.col("home_before") + S.home_advantage("neutral", advantage)
    return (
        joined.withColumn("expected_home", S.expected_score(adjusted, F.col("away_before")))
        .withColumn("expected_away", 1.0 - F.col("expected_home"))
        .withColumn("actual_home", S.actual_score(F.col("home_score"), F.col("away_score")))
        .withColumn("home_after", F.col("home_before") + F.col("rating_change"))
        .withColumn("away_after", F.col("away_before") - F.col("rating_change"))
    )


def _elo_replay(order: list[str], k: float, advantage: float, start: float) -> Replay:
    """A state is a team's rating, under its id in match_id and home_before."""
    def replay(pdf: pd.DataFrame, states: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        pdf = pdf.sort_values(order, kind="stable")
        ratings: dict[int, float] = {} if states is None else dict(zip(states["match_id"].tolist(), states["home_before"].tolist()))
        rows = []
        for m, h, a, hs, as_, neutral, weight in zip(*[pdf[c].tolist() for c in (
                "match_id", "home_id", "away_id", "home_score", "away_score", "neutral", "weight")]):
            rh, ra = ratings.get(h, start), ratings.get(a, start)
            diff = rh + (0.0 if neutral else advantage) - ra
            gap = abs(hs - as_)
            margin = 1.0 if gap <= 1 else math.log(gap + 1.0) * 2.2 / (0.001 * abs(diff) + 2.2)
            won = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
            change = k * weight * margin * (won - 1.0 / (1.0 + 10.0 ** (-diff / 400.0)))
            ratings[h], ratings[a] = rh + change, ra - change
            rows.append((m, rh, ra, change))
        after = [(t, r, None, None) for t, r in ratings.items()]
        return pd.DataFrame(rows, columns=ELO_COLUMNS), pd.DataFrame(after, columns=ELO_COLUMNS)

    return replay


def _elo_fixed_point(pool: DataFrame, order: list[str], k: float, advantage: float, start: float, block_rows: int,
                     hot_rows: int = skew.HOT_ROWS, tolerance: float = 1e-10) -> DataFrame:
    """Elo of one pool solved without any replay; the tests compare the replays with it.

    Guess every change, take running sums per team to get ratings before each match, recompute every
    change, repeat. A match whose dependencies are settled is exact after the next round, so the
    iteration always ends, but where teams play thousands of matches in a block it needs as many rounds.
    """
    spark = pool.sparkSession
    ensure_checkpoint_dir(spark)
    limits = pool.agg(F.count("*").alias("n"), F.min("match_date").alias("lo"), F.max("match_date").alias("hi")).first()
    blocks = max(1, math.ceil(limits["n"] / block_rows))
    span = max(1, (limits["hi"] - limits["lo"]).days + 1)
    block = F.floor(F.date_diff("match_date", F.lit(limits["lo"])) * blocks / span)
    base = pool.withColumn("__block", block)
    folder = f"{spark.sparkContext.getCheckpointDir()}/elo-{uuid.uuid4().hex}"
    base.write.partitionBy("__block").parquet(f"{folder}/input")
    stored = spark.read.parquet(f"{folder}/input")
    state: DataFrame | None = None
    for b in range(blocks):
        part = stored.filter(F.col("__block") == b).drop("__block")
        solved, state = _elo_block(part, state, order, k, advantage, start, hot_rows, tolerance)
        solved.select("match_id", "home_before", "away_before", "rating_change").write.mode("append").parquet(f"{folder}/output")
    return spark.read.schema(ELO_SCHEMA).parquet(f"{folder}/output")


def _elo_block(part: DataFrame, state: DataFrame | None, order: list[str], k: float, advantage: float, start: float,
               hot_rows: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    change = S.elo_change(F.col("home_before"), F.col("away_before"), F.col("home_score"), F.col("away_score"), "neutral",
                          F.col("weight"), k, advantage)
    for side in ("home", "away"):
        if state is None:
            part = part.withColumn(f"{side}_start", F.lit(start))
        else:
            prior = state.select(F.col("team_id").alias(f"{side}_id"), F.col("rating").alias(f"{side}_start"))
            part = part.join(prior, f"{side}_id", "left").withColumn(f"{side}_start", F.coalesce(f"{side}_start", F.lit(start)))
    keep = [*CARRIED, "home_start", "away_start"]
    both = F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_id").alias("team_id"), F.lit(1.0).alias("sign")),
        F.struct(F.lit("away").alias("side"), F.col("away_id").alias("team_id"), F.lit(-1.0).alias("sign")))).alias("s")
    sides = part.select(*keep, both).select(*keep, "s.*")
    chunked, any_hot = skew.assign_chunks(sides, ["team_id"], micros(F.col("match_date").cast("timestamp")), hot_rows)
    sides = chunked.drop(skew.HOT).checkpoint()
    current = part.withColumn("home_before", F.col("home_start")).withColumn("away_before", F.col("away_start"))
    current = current.withColumn("rating_change", change).select("match_id", "home_before", "away_before", "rating_change").checkpoint()
    while True:
        moved = sides.join(current.select("match_id", "rating_change"), "match_id").withColumn("__d", F.col("sign") * F.col("rating_change"))
        summed = skew.running_sum(moved, ["team_id"], order, "__d", "__sum", skew.CHUNK if any_hot else None)
        first = [F.first(c).alias(c) for c in ("home_score", "away_score", "neutral", "weight", "home_start", "away_start")]
        paired = summed.groupBy("match_id").agg(
            *first, F.first("rating_change").alias("__old"),
            F.max(F.when(F.col("side") == "home", F.col("__sum"))).alias("__h"), F.max(F.when(F.col("side") == "away", F.col("__sum"))).alias("__a"))
        nxt = (
            paired.withColumn("home_before", F.col("home_start") + F.col("__h")).withColumn("away_before", F.col("away_start") + F.col("__a"))
            .withColumn("rating_change", change)
            .select("match_id", "home_before", "away_before", "rating_change", "__old").checkpoint()
        )
        gap = nxt.agg(F.max(F.abs(F.col("rating_change") - F.col("__old")))).first()[0] or 0.0
        current = nxt.drop("__old")
        if gap <= tolerance:
            break
    totals = sides.join(current, "match_id").groupBy("team_id").agg(F.sum(F.col("sign") * F.col("rating_change")).alias("rating"))
    if state is None:
        updated = totals.withColumn("rating", F.col("rating") + start)
    else:
        updated = state.withColumn("fresh", F.lit(0)).unionByName(totals.withColumn("fresh", F.lit(1))).groupBy("team_id").agg(
            (F.sum("rating") + F.when(F.max(F.col("fresh") == 0), F.lit(0.0)).otherwise(F.lit(start))).alias("rating"))
    return current, updated.checkpoint()


def elo_final(history: DataFrame, order: list[str] = DATE_ORDER) -> DataFrame:
    """Current rating per team: the last rating after a match, in replay order."""
    sides = F.explode(F.array(*[
        F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"{s}_after").alias("rating")) for s in ("home", "away")])).alias("s")
    position = F.struct(*order)
    return history.select("pool", position.alias("p"), sides).groupBy("pool", "s.team_id").agg(
        F.max_by("s.rating", "p").alias("rating"), F.count("*").alias("matches"))


def elo_snapshots(history: DataFrame) -> DataFrame:
    """Rating after every match, per team, with the time everything behind it was published (if known)."""
    sides = F.explode(F.array(*[
        F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"{s}_after").alias("rating")) for s in ("home", "away")])).alias("s")
    return history.select("match_id", F.col("match_date").alias("effective_date"), F.col("match_id").alias("snapshot_order"), sides).select(
        "match_id", "effective_date", "snapshot_order", "s.*")


def publication_times(matches: DataFrame) -> DataFrame:
    """Per date, when every result up to it was usable. One row per calendar day feeds the running maximum."""
    daily = matches.filter(F.col("eligible_at").isNotNull()).groupBy("match_date").agg(F.max("eligible_at").alias("m"))
    running = Window.orderBy("match_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(F.col("match_date").alias("effective_date"), F.max("m").over(running).alias("usable_at"))


def with_publication(history: DataFrame, matches: DataFrame, out: str = "available_at") -> DataFrame:
    return history.join(publication_times(matches).withColumnRenamed("usable_at", out), "effective_date")


def ambiguous_order(matches: DataFrame) -> DataFrame:
    """Teams that play twice on a date of which at least one kickoff is unknown."""
    sides = F.explode(F.array("home_id", "away_id")).alias("team_id")
    return matches.select("match_date", "kickoff_at", sides).groupBy("match_date", "team_id").agg(
        F.count("*").alias("matches"), F.count_if(F.col("kickoff_at").isNull()).alias("unknown_kickoffs")
    ).filter("matches > 1 AND unknown_kickoffs > 0")


# ---- Glicko ----------------------------------------------------------------------------------------

GLICKO_SCHEMA = ("team_id BIGINT, effective_date DATE, rating_before DOUBLE, deviation_before DOUBLE, rating DOUBLE, "
                 "deviation DOUBLE")


GLICKO_COLUMNS = ["team_id", "effective_date", "rating_before", "deviation_before", "rating", "deviation"]


def glicko_history(matches: DataFrame, pool: Column | None = None, pool_rows: int = POOL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """State per team and day played; all matches of a day use the states before that day."""
    needs = ["match_date", "match_id", "home_id", "away_id", "home_score", "away_score"]
    result = _replayed(_prepare(matches, pool), _glicko_replay, needs, GLICKO_SCHEMA, pool_rows, block_rows)
    return result.drop("pool").withColumn("rating_change", F.col("rating") - F.col("rating_before"))


def _glicko_replay(pdf: pd.DataFrame, known: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A state is the row of the last day a team played."""
    start, q = S.GLICKO_START, S.GLICKO_Q
    states: dict[int, tuple] = {}
    if known is not None:
        states = {t: (r, d, day) for t, day, r, d in zip(*[known[c].tolist() for c in ("team_id", "effective_date", "rating", "deviation")])}
    rows = []
    for day, games in pdf.sort_values(["match_date", "match_id"]).groupby("match_date", sort=True):
        prior, attenuation, info, resid = {}, {}, {}, {}
        home, away, hs_, as__ = [games[c].tolist() for c in ("home_id", "away_id", "home_score", "away_score")]
        for team in set(home) | set(away):
            r, d, last = states.get(team, (*start, day))
            prior[team] = (r, min(S.GLICKO_MAX_DEVIATION, math.sqrt(d * d + S.GLICKO_MONTHLY_DRIFT**2 * (day - last).days / 30.0)))
            attenuation[team] = 1.0 / math.sqrt(1.0 + 3.0 * q * q * prior[team][1] ** 2 / math.pi**2)
        for h, a, hs, as_ in zip(home, away, hs_, as__):
            won = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
            for own, other, score in ((h, a, won), (a, h, 1.0 - won)):
                g = attenuation[other]
                e = 1.0 / (1.0 + 10.0 ** max(-300.0, min(300.0, -g * (prior[own][0] - prior[other][0]) / 400.0)))
                info[own] = info.get(own, 0.0) + q * q * g * g * e * (1.0 - e)
                resid[own] = resid.get(own, 0.0) + g * (score - e)
        for team, (r, d) in prior.items():
            precision = 1.0 / (d * d) + info[team]
            states[team] = (r + q / precision * resid[team], math.sqrt(1.0 / precision), day)
            rows.append((team, day, r, d, states[team][0], states[team][1]))
    after = [(t, day, None, None, r, d) for t, (r, d, day) in states.items()]
    return pd.DataFrame(rows, columns=GLICKO_COLUMNS), pd.DataFrame(after, columns=GLICKO_COLUMNS)


def glicko_expectation(own_rating: Column, other_rating: Column, deviation_squared: Column) -> tuple[Column, Column]:
    """Attenuation g for an uncertainty, and the expected score under it."""
    g = 1.0 / F.sqrt(1.0 + 3.0 * S.GLICKO_Q**2 * deviation_squared / math.pi**2)
    exponent = F.greatest(F.lit(-300.0), F.least(F.lit(300.0), -g * (own_rating - other_rating) / 400.0))
    return g, 1.0 / (1.0 + F.pow(F.lit(10.0), exponent))


def current_ratings(history: DataFrame, as_of: str) -> DataFrame:
    """Latest state per team, deviation grown to the moment, with its 95% rating-scale interval."""
    from .asof import latest_per

    day = F.lit(as_of).cast("date")
    latest = latest_per(history.filter(F.col("effective_date") <= day), ["team_id"], ["effective_date"])
    dev = S.inflate_deviation(F.col("deviation"), F.date_diff(day, F.col("effective_date")).cast("double"))
    return latest.withColumn("deviation", dev).withColumn("lower", F.col("rating") - 1.96 * F.col("deviation")).withColumn(
        "upper", F.col("rating") + 1.96 * F.col("deviation"))


def movers(ratings: DataFrame, k: int | None = None) -> DataFrame:
    """Teams by the size of their last change, all or the first k."""
    ordered = ratings.orderBy(F.abs("rating_change").desc(), "team_id")
    return ordered if k is None else ordered.limit(k)


# ---- pre-match table -------------------------------------------------------------------------------

PRE_MATCH_COLUMNS = [
    "home_elo_pre", "away_elo_pre", "elo_diff_home_minus_away", "abs_elo_diff", "elo_expected_home_score",
    "elo_expected_away_score", "is_neutral", "is_world_cup", "tournament_importance",
    *[f"{s}_form_{n}_{m}_per_match" for n in (5, 10) for m in ("points", "goal_diff", "goals_for", "goals_against") for s in ("home", "away")],
]


def pre_match_table(results: DataFrame, pool: Column | None = None, pool_rows: int = POOL_ROWS, elo: DataFrame | None = None) -> DataFrame:
    """One row per completed match: replayed ratings, context and form before it, then the target.

    elo: the Elo history of the same results, where it was replayed already.
    """
    elo = elo_history(results, pool, DATE_ORDER, pool_rows=pool_rows) if elo is None else elo
    form = replay_form(results)
    metrics = [c for c in form.columns if c.startswith("form_")]
    wide = form.groupBy("match_id").agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in metrics])
    names = results.select("match_id", "tournament")
    h, a = F.col("home_before"), F.col("away_before")
    return elo.join(wide, "match_id").join(names, "match_id").select(
        "match_id", "match_date", "home_id", "away_id", "tournament", "neutral",
        h.alias("home_elo_pre"), a.alias("away_elo_pre"), (h - a).alias("elo_diff_home_minus_away"), F.abs(h - a).alias("abs_elo_diff"),
        F.col("expected_home").alias("elo_expected_home_score"), F.col("expected_away").alias("elo_expected_away_score"),
        F.col("neutral").cast("int").alias("is_neutral"), (F.lower(F.trim("tournament")) == "fifa world cup").cast("int").alias("is_world_cup"),
        F.col("weight").alias("tournament_importance"), *[F.col(f"{s}_{c}") for s in ("home", "away") for c in metrics],
        "home_score", "away_score", (F.col("home_score") - F.col("away_score")).alias("goal_diff_home_minus_away"),
        outcome_label("home_score", "away_score").alias("outcome"))
