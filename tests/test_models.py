"""Fitted models against independent solutions, and distributed algorithms against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prematch.functions import probability as P
from prematch.operators import baselines as B
from prematch.operators import classifiers as C
from prematch.operators import decisions as D
from prematch.operators import evaluation as V
from prematch.operators import opponent as O
from prematch.operators import quantiles as Q
from prematch.operators import transforms as T


@pytest.fixture(scope="module")
def goals():
    rng = np.random.default_rng(11)
    att, dfn = rng.normal(0, 0.3, 6), rng.normal(0, 0.3, 6)
    rows = []
    for i in range(300):
        h, a = rng.choice(6, 2, replace=False)
        neutral = bool(rng.random() < 0.3)
        lh = math.exp(0.3 + att[h] + dfn[a] + (0 if neutral else 0.25))
        rows.append((i, int(h), int(a), int(rng.poisson(lh)), int(rng.poisson(math.exp(0.3 + att[a] + dfn[h]))), neutral))
    return rows


def newton(rows, penalty=5.0, n=6):
    """Plain Newton solve of the penalised joint likelihood."""
    x, y = [], []
    for _, h, a, hs, as_, neutral in rows:
        for own, other, host, g in ((h, a, 0.0 if neutral else 1.0, hs), (a, h, 0.0, as_)):
            v = np.zeros(2 + 2 * n)
            v[0], v[1], v[2 + own], v[2 + n + other] = 1, host, 1, 1
            x.append(v), y.append(g)
    x, y, theta = np.array(x), np.array(y, float), np.zeros(2 + 2 * n)
    ridge = np.full(2 + 2 * n, penalty)
    ridge[0] = 0
    for _ in range(60):
        mu = np.exp(x @ theta)
        theta -= np.linalg.solve(x.T @ (x * mu[:, None]) + np.diag(ridge), x.T @ (mu - y) + ridge * theta)
    att, dfn = theta[2:2 + n], theta[2 + n:]
    return theta[0] + att.mean() + dfn.mean(), theta[1], att - att.mean(), dfn - dfn.mean()


def test_joint_goal_model_equals_newton(spark, goals):
    df = spark.createDataFrame(goals, "match_id LONG, home_id INT, away_id INT, home_score INT, away_score INT, neutral BOOLEAN")
    teams, scalars = O.fit_opponent_poisson(df)
    base, home, att, dfn = newton(goals)
    assert scalars["base"] == pytest.approx(base, abs=1e-5) and scalars["home"] == pytest.approx(home, abs=1e-5)
    got = {int(r["team"]): (r["attack"], r["defence"]) for r in teams.collect()}
    for i in range(6):
        assert got[i] == pytest.approx((att[i], dfn[i]), abs=1e-5)
    assert O.beyond_bounds(teams, scalars).count() == 0
    assert all(abs(r["slope"]) < 1e-6 for r in O.goal_model_slopes(df, teams, scalars).collect())
    with pytest.raises(ValueError, match="not settled"):
        O.fit_opponent_poisson(df, max_passes=3)
    with pytest.raises(ValueError, match="at least one"):
        O.fit_opponent_poisson(df.limit(0))


def test_joint_goal_model_on_a_chain_and_separate_leagues(spark):
    """Teams that meet only their neighbours, one that never scores, and a league apart: where descent by blocks crawls."""
    rng = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    rows = [(n, h, a, 0 if h == 7 else int(rng.poisson(1.6)), int(rng.poisson(1.1)), n % 3 == 0) for n, (h, a) in enumerate(pairs * 3)]
    df = spark.createDataFrame(rows, "match_id LONG, home_id INT, away_id INT, home_score INT, away_score INT, neutral BOOLEAN")
    teams, scalars = O.fit_opponent_poisson(df, penalty=0.01)
    assert teams.count() == 44 and all(abs(r["slope"]) < 1e-6 for r in O.goal_model_slopes(df, teams, scalars, 0.01).collect())


def test_components_of_paths_rings_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(edges)
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    got = {r["node"]: r["component"] for r in O.connected_components(spark.createDataFrame(edges, "a INT, b INT")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200, 202: 200}


def test_disconnected_and_unseen_teams_are_refused(spark):
    teams = spark.createDataFrame([("1", 0.1, 0.0), ("2", 0.0, 0.0), ("3", 0.0, 0.0)], "team STRING, attack DOUBLE, defence DOUBLE")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node INT, component INT")
    fx = spark.createDataFrame([(1, 1, 2, False), (2, 1, 3, True), (3, 1, 9, True)], "match_id INT, home_id INT, away_id INT, neutral BOOLEAN")
    got = {r["match_id"]: (r["rejected"], r["home_rate"]) for r in O.opponent_rates(fx, teams, {"base": 0.2, "home": 0.3}, comp).collect()}
    assert got[1] == (None, pytest.approx(math.exp(0.6))) and got[2] == ("disconnected_teams", None) and got[3] == ("no_goal_history", None)


def test_score_grid_equals_enumeration(spark):
    got = B.score_grid(spark.createDataFrame([(1.7, 0.9), (0.2, 5.0)], "home_rate DOUBLE, away_rate DOUBLE")).collect()
    for r in got:

        def pmf(rate):
            out = [math.exp(-rate)]
            for k in range(1, 11):
                out.append(out[-1] * rate / k)
            return out

        h, a = pmf(r["home_rate"]), pmf(r["away_rate"])
        kept = sum(h) * sum(a)
        assert r["p_home"] == pytest.approx(sum(h[i] * a[j] for i in range(11) for j in range(11) if i > j) / kept)
        assert r["p_home"] + r["p_draw"] + r["p_away"] == pytest.approx(1.0)
        assert (r["mode_home"], r["mode_away"]) == max(((i, j) for i in range(11) for j in range(11)), key=lambda c: (h[c[0]] * a[c[1]], -c[0], -c[1]))
        assert r["omitted_tail"] == pytest.approx(1 - kept)


def test_mirrored_fixture_gives_the_mirrored_forecast(spark):
    teams = spark.createDataFrame([(1, 10, 1.3, 1.2, 0.8), (2, 10, 1.3, 0.7, 1.4)], "team_id INT, matches INT, global_rate DOUBLE, attack DOUBLE, defence DOUBLE")
    fx = spark.createDataFrame([(1, 1, 2, True), (2, 2, 1, True)], "match_id INT, home_id INT, away_id INT, neutral BOOLEAN")
    r = {x["match_id"]: x for x in B.score_grid(B.expected_goals(fx, teams)).collect()}
    assert r[1]["p_home"] == pytest.approx(r[2]["p_away"]) and r[1]["p_draw"] == pytest.approx(r[2]["p_draw"])


def sharp(spark, n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = [rng.random() + 0.05 for _ in range(3)]
        p = [x / sum(p) for x in p]
        q = [x**2.5 for x in p]
        q = [x / sum(q) for x in q]
        u = rng.random()
        rows.append((i, "home_win" if u < p[0] else "draw" if u < p[0] + p[1] else "away_win", *q, *p))
    return spark.createDataFrame(rows, "match_id INT, actual STRING, p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE, q_home DOUBLE, q_draw DOUBLE, q_away DOUBLE").repartition(4)


def test_temperature_fit_minimises_the_loss(spark):
    df = sharp(spark)
    best = T.fit_temperature(df)
    rows = df.collect()

    def loss(t):
        total = 0.0
        for r in rows:
            w = {k: r[f"p_{s}"] ** (1 / t) for k, s in zip(("home_win", "draw", "away_win"), ("home", "draw", "away"))}
            total -= math.log(w[r["actual"]] / sum(w.values()))
        return total / len(rows)

    assert 1.5 < best < 4.0
    assert loss(best) <= min(loss(0.25 + 0.01 * i) for i in range(376)) + 1e-9


def test_ensemble_fit_minimises_the_penalised_loss(spark):
    df = sharp(spark)
    w = T.fit_ensemble(df, ["p_", "q_"])
    rows = df.collect()
    side = {"home_win": "home", "draw": "draw", "away_win": "away"}

    def loss(a):
        return sum(-math.log(a * r["p_" + side[r["actual"]]] + (1 - a) * r["q_" + side[r["actual"]]]) for r in rows) / len(rows) + 0.01 * ((a - 0.5) ** 2 + (0.5 - a) ** 2)

    assert sum(w) == pytest.approx(1.0)
    assert loss(w[0]) <= min(loss(i / 2000) for i in range(2001)) + 1e-6


def test_exact_quantiles_with_heavy_ties_and_outliers(spark):
    rng = random.Random(9)
    data = {"a": [rng.gauss(0, 1) for _ in range(500)] + [1e9], "b": [3.0] * 300 + [rng.random() for _ in range(77)], "c": [1.5]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "feature STRING, value DOUBLE").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["feature"]: r["quantiles"] for r in Q.exact_quantiles(df, "feature", "value", probs).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, probs)))


def test_drift_is_zero_on_itself(spark):
    df = spark.createDataFrame([("f", float(i % 37)) for i in range(400)], "feature STRING, value DOUBLE")
    r = V.feature_drift(df, df).first()
    assert r["psi"] == pytest.approx(0.0, abs=1e-12) and r["outside_reference_range"] == 0.0


def test_bootstrap_repeats_and_needs_four_blocks(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "draw", 0.3, 0.4, 0.3, 0.2, 0.6, 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "prediction_time TIMESTAMP, actual STRING, p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE, q_home DOUBLE, q_draw DOUBLE, q_away DOUBLE")
    run = lambda d: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in V.block_bootstrap(V.block_sums(d), 200).orderBy("metric").collect()]
    first = run(df)
    assert first == run(df.repartition(7))
    for _, metric, delta, low, high, status in first:
        assert status == "estimated" and low <= delta + 1e-9 and high >= delta - 1e-9
    assert all(r[5] == "insufficient_blocks" and r[3] is None for r in run(df.limit(40)))


def test_settlement_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    ledger = [(i, rng.choice("AB"), rng.choice("CD"), rng.choice([None, 1, 2]), rng.choice(["home_win", "draw", "away_win"]), 2.0, 3.0, 4.0, rng.choice([None, 5.0]),
               rng.choice([None, None, "draw"])) for i in range(60)]
    results = [(i, rng.choice("AB"), rng.choice("CD"), rng.choice([None, 1, 2, 3]), rng.randint(0, 2), rng.randint(0, 2), rng.choice([None, 1.9])) for i in range(12)]
    want = {}
    for i, h, a, k, best, ho, do, ao, stake, final in ledger:
        state = (final, None)
        for o, rh, ra, rk, hs, as_, _ in results:
            if state[0] is None and (h, a) == (rh, ra) and (rk is None or k is None or rk == k):
                out = "home_win" if hs > as_ else "away_win" if hs < as_ else "draw"
                s = stake or 1.0
                odds = {"home_win": ho, "draw": do, "away_win": ao}[best]
                state = (out, s * (odds - 1) if out == best else -s)
        want[i] = state
    led = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in ledger],
        "id INT, home_team STRING, away_team STRING, kickoff INT, best_outcome STRING, home_odds DOUBLE, draw_odds DOUBLE, away_odds DOUBLE, suggested_stake_amount DOUBLE, final_outcome STRING, "
        "realized_return DOUBLE, final_home_score INT, final_away_score INT, closing_home_odds DOUBLE, closing_draw_odds DOUBLE, closing_away_odds DOUBLE")
    res = spark.createDataFrame([(*r, None, None) for r in results],
        "ord INT, home_team STRING, away_team STRING, kickoff INT, final_home_score INT, final_away_score INT, closing_home_odds DOUBLE, closing_draw_odds DOUBLE, closing_away_odds DOUBLE")
    assert {r["id"]: (r["final_outcome"], r["realized_return"]) for r in D.settle(led, res, "ord").collect()} == want


def test_stakes_respect_both_caps(spark):
    rows = [(i, "p", "actionable", "home_win", 0.9, 0.05, 0.05, 2.0, 3.0, 4.0, 0.8) for i in range(6)] + [(9, "p", "filtered", "home_win", 0.9, 0.05, 0.05, 2.0, 3.0, 4.0, 0.8)]
    df = spark.createDataFrame(rows, "id INT, book STRING, strategy_action STRING, best_outcome STRING, p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE, home_odds DOUBLE, draw_odds DOUBLE, away_odds DOUBLE, best_expected_value DOUBLE")
    got = D.size_stakes(df, ["book"]).collect()
    assert sum(r["suggested_stake_fraction"] for r in got) == pytest.approx(0.05)
    assert {r["stake_sizing_reason"] for r in got} == {"single_bet_cap_applied;portfolio_cap_scaled", "not_actionable"}


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        s = 1.8 * x + rng.gauss(0, 0.7)
        rows.append((i, x, y, "home_win" if s > 0.6 else "away_win" if s < -0.6 else "draw"))
    return spark.createDataFrame(rows, "match_id INT, x DOUBLE, y DOUBLE, target STRING").repartition(4)


def test_classifiers_beat_the_frequency_baseline(spark, learnable):
    train, test = learnable.filter("match_id < 600"), learnable.filter("match_id >= 600")
    actual = lambda df: V.metrics(df.withColumn("actual", F.col("target"))).first()["log_loss"]
    base = B.class_frequency(train)
    floor = actual(test.withColumns({f"p_{s}": base.select(f"p_{s}").scalar() for s in B.SIDES}))
    logistic = C.fit_logistic(train, ["x", "y"], "target")
    for scored in (C.score(logistic, test), C.fit_boosting(train, ["x", "y"], "target", rounds=8, depth=3, rate=0.3).score(test),
                   C.score(C.fit_forest(train, ["x", "y"], "target", numTrees=15), test)):
        assert scored.filter(~P.is_distribution(*P.triple())).count() == 0
        assert actual(scored) < floor - 0.2
    by_model = {r["match_id"]: r["p_home"] for r in C.score(logistic, test).collect()}
    by_expression = {r["match_id"]: r["p_home"] for r in C.score_logistic_expression(logistic, test, ["x", "y"]).collect()}
    assert by_model == pytest.approx(by_expression, abs=1e-9)
    top = C.top_contributions(logistic, test, ["x", "y"], "target", 1)
    assert top.count() == 300 and top.filter("feature = 'x'").count() > 200


def test_logistic_penalty_matches_the_summed_loss(spark, learnable):
    """Gradient of sum(loss) + |w|^2 / (2C) vanishes at the fitted coefficients."""
    model = C.fit_logistic(learnable, ["x", "y"], "target", 0.05)
    rows = C.score(model, learnable).collect()
    grad = np.zeros((3, 2))
    terms = C.logistic_terms(model, ["x", "y"])
    for r in rows:
        z = [(r[f] - m) / s for f, m, s, _ in terms[0][1]]
        for k, (o, side) in enumerate(zip(("home_win", "draw", "away_win"), B.SIDES)):
            grad[k] += (r[f"p_{side}"] - (r["target"] == o)) * np.array(z)
    coef = np.array([[c for *_, c in t[1]] for t in terms])
    assert np.abs(grad + coef / 0.05).max() < 0.05


def test_chronological_split_is_exact(spark):
    rng = random.Random(12)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 1, 1, 1, 2]))) for i in range(501)]
    got = V.chronological_split(spark.createDataFrame(rows, "id INT, d DATE").repartition(5), "d", "id", 0.3)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: "train" if n < int(501 * 0.7) else "test" for n, r in enumerate(ordered)}
    assert {r["id"]: r["role"] for r in got.collect()} == want
