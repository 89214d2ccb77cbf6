"""Replays against a plain loop, and the distributed solutions against the grouped map."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from prematch.operators import ratings as R


@pytest.fixture(scope="module")
def games():
    rng = random.Random(3)
    out = []
    for i in range(160):
        h, a = rng.sample(range(8), 2)
        out.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), h, a, rng.randint(0, 5), rng.randint(0, 4), rng.random() < 0.3,
                    rng.choice(["FIFA World Cup", "Friendly", "UEFA Euro", "Other"])))
    return out


def frame(spark, games):
    return spark.createDataFrame(games, "match_id LONG, match_date DATE, home_id LONG, away_id LONG, home_score INT, away_score INT, neutral BOOLEAN, tournament STRING")


def loop_elo(games):
    weights = {"FIFA World Cup": 1.6, "Friendly": 0.75, "UEFA Euro": 1.15, "Other": 1.0}
    r, out = {}, {}
    for m, d, h, a, hs, as_, neutral, name in sorted(games, key=lambda g: (g[1], g[2], g[3], g[0])):
        rh, ra = r.get(h, 1500.0), r.get(a, 1500.0)
        diff = rh + (0 if neutral else 75) - ra
        mult = 1.0 if abs(hs - as_) <= 1 else math.log(abs(hs - as_) + 1) * 2.2 / (0.001 * abs(diff) + 2.2)
        s = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
        c = 20 * weights[name] * mult * (s - 1 / (1 + 10 ** (-diff / 400)))
        r[h], r[a] = rh + c, ra - c
        out[m] = (rh, ra, c)
    return out, r


def close(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-7), key


def elo_dict(df):
    return {r["match_id"]: (r["home_before"], r["away_before"], r["rating_change"]) for r in df.collect()}


def test_elo_grouped_equals_loop(spark, games):
    want, final = loop_elo(games)
    history = R.elo_history(frame(spark, games))
    close(elo_dict(history), want)
    close({r["team_id"]: r["rating"] for r in R.elo_final(history).collect()}, final)


@pytest.mark.parametrize("block_rows,hot", [(1000, 4_000_000), (45, 4_000_000), (90, 12)])
def test_elo_fixed_point_equals_loop(spark, games, block_rows, hot):
    prepared = R._prepare(frame(spark, games), None)
    core = R._elo_fixed_point(prepared, R.DATE_ORDER, 20.0, 75.0, 1500.0, block_rows, hot)
    close(elo_dict(core), loop_elo(games)[0])


def test_elo_large_pool_takes_the_distributed_way(spark, games):
    close(elo_dict(R.elo_history(frame(spark, games), pool_rows=50, block_rows=60)), loop_elo(games)[0])


def test_elo_ignores_input_order_and_pools_are_independent(spark, games):
    shuffled = games[:]
    random.Random(1).shuffle(shuffled)
    close(elo_dict(R.elo_history(frame(spark, shuffled))), loop_elo(games)[0])
    pooled = elo_dict(R.elo_history(frame(spark, games), F.col("tournament")))
    want = {}
    for name in {g[7] for g in games}:
        want |= loop_elo([g for g in games if g[7] == name])[0]
    close(pooled, want)


def loop_glicko(games):
    q = math.log(10) / 400
    state, out = {}, {}
    for day in sorted({g[1] for g in games}):
        today = [g for g in games if g[1] == day]
        prior = {}
        for t in {x for g in today for x in (g[2], g[3])}:
            r, d, last = state.get(t, (1500.0, 350.0, day))
            prior[t] = (r, min(350.0, math.sqrt(d * d + 2500 * (day - last).days / 30)))
        for t, (r, d) in prior.items():
            info = res = 0.0
            for _, _, h, a, hs, as_, _, _ in today:
                if t not in (h, a):
                    continue
                o = prior[a if t == h else h]
                s = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
                s = s if t == h else 1 - s
                g = 1 / math.sqrt(1 + 3 * q * q * o[1] ** 2 / math.pi**2)
                e = 1 / (1 + 10 ** (-g * (r - o[0]) / 400))
                info += q * q * g * g * e * (1 - e)
                res += g * (s - e)
            prec = 1 / d**2 + info
            state[t] = (r + q / prec * res, math.sqrt(1 / prec), day)
            out[(t, day)] = (r, d, state[t][0], state[t][1])
    return out


def glicko_dict(df):
    return {(r["team_id"], r["effective_date"]): (r["rating_before"], r["deviation_before"], r["rating"], r["deviation"]) for r in df.collect()}


def test_glicko_grouped_equals_loop(spark, games):
    close(glicko_dict(R.glicko_history(frame(spark, games))), loop_glicko(games))


def test_glicko_by_day_equals_loop(spark, games):
    few = [g for g in games if g[0] < 40]
    close(glicko_dict(R.glicko_history(frame(spark, few), pool_rows=5)), loop_glicko(few))


def test_ambiguous_order_needs_an_unknown_kickoff(spark):
    t = dt.datetime(2024, 5, 1, 12)
    rows = [(dt.date(2024, 5, 1), t, 1, 2), (dt.date(2024, 5, 1), None, 1, 3), (dt.date(2024, 5, 2), t, 4, 5), (dt.date(2024, 5, 2), t, 4, 6)]
    bad = R.ambiguous_order(spark.createDataFrame(rows, "match_date DATE, kickoff_at TIMESTAMP, home_id INT, away_id INT"))
    assert [(r["team_id"], r["matches"], r["unknown_kickoffs"]) for r in bad.collect()] == [(1, 2, 1)]


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_replay_in_blocks_equals_loop_for_every_block_size(spark, games, block_rows):
    """Each pool goes on from the states its last block left, in both orders and in Glicko, and nothing is iterated."""
    two = F.when(F.col("match_id") % 3 == 0, F.lit("a"))
    history = R.elo_history(frame(spark, games), two, pool_rows=20, block_rows=block_rows)
    want, last = {}, {}
    for mine in ([g for g in games if g[0] % 3 == 0], [g for g in games if g[0] % 3]):
        changes, final = loop_elo(mine)
        want |= changes
        last |= {("a" if mine[0][0] % 3 == 0 else "(none)", t): r for t, r in final.items()}
    close(elo_dict(history), want)
    close({(r["pool"], r["team_id"]): r["rating"] for r in R.elo_final(history).collect()}, last)
    close(glicko_dict(R.glicko_history(frame(spark, games), pool_rows=20, block_rows=block_rows)), loop_glicko(games))
