"""Probability transforms fitted on held-out rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions.common import OUTCOMES, compact_codes

EPSILON = 1e-12
T_LOW, T_HIGH = 0.25, 4.0
RIDGE = 0.01


def scaled(probs: tuple[Column, ...], temperature: float) -> tuple[Column, ...]:
    """Softmax of log-probabilities divided by the temperature."""
    logits = [F.ln(F.greatest(p, F.lit(EPSILON))) / temperature for p in probs]
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    return P.renormalise(*powers)


def _loss_columns(held_out: DataFrame, temperatures: list[float], prefix: str) -> DataFrame:
    """One row with the mean log loss of every candidate, from one pass.

    With logits l and the realised outcome a, the loss at T is ln(sum exp((l_i - l_a) / T)).
    """
    logits = [F.ln(F.greatest(p, F.lit(EPSILON))) for p in P.triple(prefix)]
    gaps = held_out.select(P.pick("actual", *logits).alias("__a"), *[x.alias(f"__l{i}") for i, x in enumerate(logits)]).select(
        *[(F.col(f"__l{i}") - F.col("__a")).alias(f"__g{i}") for i in range(3)])

    def loss(t: float) -> Column:
        return F.avg(F.ln(F.exp(F.col("__g0") / t) + F.exp(F.col("__g1") / t) + F.exp(F.col("__g2") / t)))

    return gaps.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(temperatures)])


def temperature_table(held_out: DataFrame, temperatures: list[float], prefix: str = "p_") -> DataFrame:
    """Candidate losses as rows (temperature, log_loss)."""
    one = _loss_columns(held_out, temperatures, prefix)
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("log_loss")) for i, t in enumerate(temperatures)])))


def fit_temperature(held_out: DataFrame, prefix: str = "p_", points: int = 16, rounds: int = 5) -> float:
    """One temperature in [0.25, 4]: the best of a grid refined around its minimum; 1.0 always competes."""
    low, high, best = T_LOW, T_HIGH, (float("inf"), 1.0)
    for _ in range(rounds):
        step = (high - low) / points
        grid = [low + i * step for i in range(points + 1)]
        losses = list(_loss_columns(held_out, [1.0, *grid], prefix).first())
        best = min(best, *zip(losses, [1.0, *grid]))
        around = min(zip(losses[1:], grid))[1]
        low, high = max(T_LOW, around - step), min(T_HIGH, around + step)
    return best[1]


def simplex(k: int, parts: int) -> list[tuple[float, ...]]:
    """All weight vectors of k members in steps of 1/parts."""
    return [tuple(x / parts for x in (*c, parts - sum(c))) for c in itertools.product(range(parts + 1), repeat=k - 1) if sum(c) <= parts]


def _realised(held_out: DataFrame, members: list[str]) -> DataFrame:
    """What each member gave to the realised outcome."""
    return held_out.select(*[P.pick("actual", *P.triple(m)).alias(f"__m{i}") for i, m in enumerate(members)])


def _penalised(weights: tuple[float, ...], members: list[str], ridge: float) -> Column:
    mix = sum((w * F.col(f"__m{i + 1}") for i, w in enumerate(weights[1:])), weights[0] * F.col("__m0"))
    pull = ridge * sum((w - 1 / len(members)) ** 2 for w in weights)
    return F.avg(-F.ln(F.greatest(mix, F.lit(EPSILON)))) + F.lit(pull)


def ensemble_table(held_out: DataFrame, members: list[str], parts: int = 10, ridge: float = RIDGE) -> DataFrame:
    """Penalised loss per weight vector of a simplex grid, from one pass."""
    grid = simplex(len(members), parts)
    one = _realised(held_out, members).agg(*[_penalised(w, members, ridge).alias(f"w{i}") for i, w in enumerate(grid)])
    return one.select(F.inline(F.array(*[
        F.struct(*[F.lit(x).alias(f"w{j}") for j, x in enumerate(w)], F.col(f"w{i}").alias("loss")) for i, w in enumerate(grid)])))


def fit_ensemble(held_out: DataFrame, members: list[str], parts: int = 10, ridge: float = RIDGE, rounds: int = 6) -> tuple[float, ...]:
    """Convex weights minimising the penalised loss: grid, then ever smaller moves around the best vector."""
    def losses(vectors):
        return list(_realised(held_out, members).agg(*[_penalised(w, members, ridge).alias(f"w{i}") for i, w in enumerate(vectors)]).first())

    k = len(members)
    start = [tuple(1 / k for _ in members), *simplex(k, parts)]
    value, best = min(zip(losses(start), start))
    step = 1 / parts
    for _ in range(rounds):
        step /= 4
        moves = []
        for i, j in itertools.permutations(range(k), 2):
            for size in (1, 2, 4):
                amount = min(step * size, best[j])
                if amount > 0:
                    moves.append(tuple(w + amount if x == i else w - amount if x == j else w for x, w in enumerate(best)))
        if moves:
            value, best = min((value, best), min(zip(losses(moves), moves)))
    return best


def apply_ensemble(rows: DataFrame, members: list[str], weights: tuple[float, ...], out: str = "e_") -> DataFrame:
    sides = ("home", "draw", "away")
    return rows.withColumns({
        out + s: sum((w * F.col(m + s) for w, m in zip(weights[1:], members[1:])), weights[0] * F.col(members[0] + s)) for s in sides})


def apply_temperature(rows: DataFrame, temperature: float, prefix: str = "p_", out: str = "c_") -> DataFrame:
    return rows.withColumns({out + s: p for s, p in zip(("home", "draw", "away"), scaled(P.triple(prefix), temperature))})


def held_out_violations(held_out: DataFrame, fitted_at: str, members: DataFrame, train: DataFrame) -> DataFrame:
    """Held-out rows unfit for fitting a transform.

    members: member, member_fitted_at; train: member, match_id (the rows each member was trained on).
    """
    at = F.lit(fitted_at).cast("timestamp")
    newest = members.agg(F.max("member_fitted_at")).scalar()
    trained = train.select("match_id").distinct().withColumn("__trained", F.lit(True))
    copies = held_out.groupBy("match_id").agg(F.count("*").alias("__copies"))
    j = held_out.join(trained, "match_id", "left").join(copies, "match_id")
    codes = compact_codes({
        "not_settled_before_fit": (F.col("prediction_time") >= at) | (F.col("target_available_at") > at),
        "member_newer_than_row": newest > F.col("prediction_time"),
        "row_in_member_training": F.col("__trained").isNotNull(),
        "repeated_match": F.col("__copies") > 1,
    })
    return j.withColumn("violations", codes).filter(F.size("violations") > 0).drop("__trained", "__copies")


def sample_requirements(rows: DataFrame, target: str, min_rows: int) -> DataFrame:
    """Whether a sample is large enough and shows every outcome."""
    out = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(target) == o).alias(o) for o in OUTCOMES])
    return out.withColumn("problems", compact_codes({
        "too_few_rows": F.col("n") < min_rows, **{f"no_{o}": F.col(o) == 0 for o in OUTCOMES}}))
