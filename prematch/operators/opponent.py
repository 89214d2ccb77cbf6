"""Joint attack/defence goal model and the opponent graph."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .history import team_rows
from .passes import summed_vectors

PENALTY = 5.0
TOLERANCE = 1e-7    # goals
MAX_PASSES = 5000
BOUNDS = {"base": (-5.0, 3.0), "home": (-2.0, 2.0), "team": (-3.0, 3.0)}


def connected_components(edges: DataFrame, rounds_per_check: int = 2) -> DataFrame:
    """(node, component) with the smallest node as the component's label.

    Labels flow along edges and then jump to the label of their label, so the rounds grow with the
    logarithm of the diameter. Each round is two joins and a map-side combined minimum.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")).checkpoint()
    while True:
        current = labels
        for _ in range(rounds_per_check):
            seen = both.join(current.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
            stepped = current.join(seen, "x", "left").select("x", F.least("l", "m").alias("l"))
            parent = stepped.select(F.col("x").alias("l"), F.col("l").alias("ll"))
            current = stepped.join(parent, "l", "left").select("x", F.least("l", "ll").alias("l"))
        current = current.checkpoint()
        moved = current.join(labels.withColumnRenamed("l", "old"), "x").filter("l <> old").limit(1).count()
        labels = current
        if moved == 0:
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))


def opponent_components(matches: DataFrame) -> DataFrame:
    return connected_components(matches.select(F.col("home_id").alias("a"), F.col("away_id").alias("b")))


def pair_totals(train: DataFrame) -> DataFrame:
    """Matches and goals per (attacker, defender, host): the sufficient statistics of the model."""
    rows = team_rows(train.withColumn("kickoff_at", F.lit(None).cast("timestamp")).withColumn("match_date", F.lit(None).cast("date")), ["neutral"])
    host = ((F.col("side") == "home") & ~F.col("neutral")).cast("double")
    return rows.groupBy(F.col("team_id").alias("attacker"), F.col("opponent_id").alias("defender"), host.alias("host")).agg(
        F.count("*").cast("double").alias("n"), F.sum("goals_for").cast("double").alias("goals"))


def fit_opponent_poisson(train: DataFrame, penalty: float = PENALTY, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> tuple[DataFrame, dict]:
    """(team, attack, defence) and {base, home, passes}: penalised joint fit on pair totals.

    Newton steps whose linear systems are solved by preconditioned conjugate gradients, at every size: slopes and curvature-vector
    products are sums over the pair totals, one pass each, and only the coefficients (two per team) are on the driver. Ends when no slope of the
    objective is over ``tolerance`` goals; raises if that takes more than ``max_passes`` passes. Effects are centred, which only moves the
    base: the likelihood does not see a common shift. No rows: ValueError.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    totals = pair_totals(train).checkpoint()
    teams = sorted(r[0] for r in totals.select(F.explode(F.array("attacker", "defender"))).distinct().collect())
    if not teams:
        raise ValueError("The goal model needs at least one match.")
    k = len(teams)
    index = spark.createDataFrame(list(enumerate(teams)), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("team", totals.schema["attacker"].dataType)]))
    pairs = totals.join(index.withColumnsRenamed({"i": "a", "team": "attacker"}), "attacker").join(index.withColumnsRenamed({"i": "d", "team": "defender"}), "defender")
    pairs = pairs.select("a", "d", "host", "n", "goals").checkpoint()
    ridge = np.concatenate(([0.0], np.full(2 * k + 1, penalty)))  # base, home, attacks, defences
    spent = 0

    def one_pass(work):
        nonlocal spent
        spent += 1
        if spent > max_passes:
            raise ValueError(f"The goal model has not settled after {max_passes} passes.")
        return summed_vectors(pairs, work, 1)[0]

    def columns(batch):
        return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "d", "host", "n", "goals"))

    def per_coefficient(v, a, d, host):
        return np.concatenate(([v.sum(), (v * host).sum()], np.bincount(a, v, k), np.bincount(d, v, k)))

    def expected(theta, a, d, host, n):
        return n * np.exp(theta[0] + theta[1] * host + theta[2:2 + k][a] + theta[2 + k:][d])

    def state(theta):
        def work(batch):
            a, d, host, n, goals = columns(batch)
            mu = expected(theta, a, d, host, n)
            yield 0, np.concatenate(([(mu - goals * np.log(np.maximum(mu / n, 1e-300))).sum()], per_coefficient(mu - goals, a, d, host), per_coefficient(mu, a, d, host)))
        v = one_pass(work)
        curve = v[3 + 2 * k:] + ridge
        curve[1] = max(curve[1], 1e-12)
        return v[0] + 0.5 * (ridge * theta ** 2).sum(), v[1:3 + 2 * k] + ridge * theta, curve

    def curved(theta, p):
        def work(batch):
            a, d, host, n, _ = columns(batch)
            yield 0, per_coefficient(expected(theta, a, d, host, n) * (p[0] + p[1] * host + p[2:2 + k][a] + p[2 + k:][d]), a, d, host)
        return one_pass(work) + ridge * p

    def newton_step(theta, slope, curve):
        step, rest = np.zeros_like(slope), slope.copy()
        z = rest / curve
        p, rz = z.copy(), rest @ z
        wanted = min(0.1, np.sqrt(np.abs(slope).max() / (1 + goals_in_all))) * np.sqrt(slope @ (slope / curve))
        while np.sqrt(rz) > wanted:
            hp = curved(theta, p)
            size = rz / (p @ hp)
            step, rest = step + size * p, rest - size * hp
            z = rest / curve
            p, rz = z + (rest @ z) / rz * p, rest @ z
        return step

    sums = totals.agg(F.sum("goals").alias("g"), F.sum("n").alias("n")).first()
    goals_in_all = sums["g"]
    theta = np.zeros(2 + 2 * k)
    theta[0] = math.log(max(sums["g"], 0.5) / sums["n"])
    loss, slope, curve = state(theta)
    while np.abs(slope).max() > tolerance:
        step = newton_step(theta, slope, curve)
        while True:
            new = state(theta - step)
            if new[0] <= loss + 1e-9 * (1 + abs(loss)):
                break
            step = step / 2
        theta = theta - step
        loss, slope, curve = new
    attack, defence = theta[2:2 + k], theta[2 + k:]
    base = float(theta[0] + attack.mean() + defence.mean())
    rows = [(str(t), float(x), float(y)) for t, x, y in zip(teams, attack - attack.mean(), defence - defence.mean())]
    return spark.createDataFrame(rows, "team STRING, attack DOUBLE, defence DOUBLE"), {"base": base, "home": float(theta[1]), "passes": spent}


def goal_model_slopes(train: DataFrame, teams: DataFrame, scalars: dict, penalty: float = PENALTY) -> DataFrame:
    """(coefficient, slope) of the penalised objective at a fitted model: 0 everywhere at its minimum."""
    named = pair_totals(train).withColumns({c: F.col(c).cast("string") for c in ("attacker", "defender")})
    rows = named.join(teams.select(F.col("team").alias("attacker"), F.col("attack").alias("a")), "attacker").join(teams.select(F.col("team").alias("defender"), F.col("defence").alias("d")), "defender")
    over = F.col("n") * F.exp(F.lit(scalars["base"]) + F.col("a") + F.col("d") + F.lit(scalars["home"]) * F.col("host")) - F.col("goals")
    part = lambda name, value, v: F.struct(name.alias("coefficient"), value.alias("value"), v.alias("v"))
    parts = F.array(part(F.lit("base"), F.lit(0.0), over), part(F.lit("home"), F.lit(float(scalars["home"])), over * F.col("host")),
                    part(F.concat(F.lit("attack:"), "attacker"), F.col("a"), over), part(F.concat(F.lit("defence:"), "defender"), F.col("d"), over))
    return rows.select(F.inline(parts)).groupBy("coefficient").agg((F.sum("v") + F.lit(penalty) * F.first("value")).alias("slope"))


def beyond_bounds(teams: DataFrame, scalars: dict) -> DataFrame:
    """Coefficients outside the declared parameter bounds."""
    lo, hi = BOUNDS["team"]
    long = teams.unpivot(["team"], ["attack", "defence"], "parameter", "value")
    extra = [(None, k, scalars[k]) for k in ("base", "home") if not BOUNDS[k][0] <= scalars[k] <= BOUNDS[k][1]]
    out = long.filter((F.col("value") < lo) | (F.col("value") > hi))
    return out.unionByName(teams.sparkSession.createDataFrame(extra, "team STRING, parameter STRING, value DOUBLE")) if extra else out


def opponent_rates(fixtures: DataFrame, teams: DataFrame, scalars: dict, components: DataFrame | None = None) -> DataFrame:
    """Goal rates under the joint model; unseen teams and teams of separate graphs are refused with a reason."""
    from .baselines import MAX_GOALS_RATE, MIN_GOALS

    out = fixtures
    for s in ("home", "away"):
        part = teams.select(F.col("team").alias(f"__{s}"), F.col("attack").alias(f"__{s}_a"), F.col("defence").alias(f"__{s}_d"))
        out = out.join(part, F.col(f"{s}_id").cast("string") == F.col(f"__{s}"), "left")
        if components is not None:
            comp = components.select(F.col("node").alias(f"{s}_id"), F.col("component").alias(f"__{s}_c"))
            out = out.join(comp, f"{s}_id", "left")
    unseen = F.col("__home_a").isNull() | F.col("__away_a").isNull()
    apart = F.lit(False) if components is None else F.col("__home_c") != F.col("__away_c")
    reason = F.when(unseen, F.lit("no_goal_history")).when(apart, F.lit("disconnected_teams"))
    effect = F.when(F.col("neutral"), F.lit(0.0)).otherwise(F.lit(scalars["home"]))
    clip = lambda x: F.greatest(F.lit(MIN_GOALS), F.least(F.lit(MAX_GOALS_RATE), F.exp(x)))
    home = clip(F.lit(scalars["base"]) + F.col("__home_a") + F.col("__away_d") + effect)
    away = clip(F.lit(scalars["base"]) + F.col("__away_a") + F.col("__home_d"))
    return out.withColumn("rejected", reason).withColumn("home_rate", F.when(F.col("rejected").isNull(), home)).withColumn(
        "away_rate", F.when(F.col("rejected").isNull(), away)).select(*fixtures.columns, "home_rate", "away_rate", "rejected")
