"""Hand-computed values of scalar functions and metrics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from prematch.functions import ids
from prematch.functions import probability as P
from prematch.functions import strength as S
from prematch.functions import text as X
from prematch.operators import evaluation as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_elo_terms(spark):
    l = lambda x: F.lit(float(x))
    got = one(spark, e=S.expected_score(l(1500), l(1500)), w=S.actual_score(l(2), l(1)), d=S.actual_score(l(1), l(1)), x=S.actual_score(l(0), l(1)),
              wc=S.importance(F.lit(" FIFA World Cup ")), q=S.importance(F.lit("FIFA World Cup qualification")), f=S.importance(F.lit("Friendly")),
              n=S.importance(F.lit("Nations League")), o=S.importance(F.lit("Island Games")), m1=S.margin_multiplier(l(2), l(1), l(300)), m3=S.margin_multiplier(l(3), l(0), l(0)))
    assert (got["e"], got["w"], got["d"], got["x"]) == (0.5, 1.0, 0.5, 0.0)
    assert (got["wc"], got["q"], got["f"], got["n"], got["o"]) == (1.6, 1.25, 0.75, 1.15, 1.0)
    assert got["m1"] == 1.0 and got["m3"] == pytest.approx(math.log(4))


def test_market_terms(spark):
    l = lambda x: F.lit(float(x))
    got = one(spark, imp=P.implied_probability(l(2)), none=P.implied_probability(l(1)), k=P.kelly_fraction(l(0.6), l(2)), ev=P.expected_value(l(0.6), l(2)),
              win=P.realised_return(F.lit("draw"), F.lit("draw"), l(2), l(3), l(4), l(10)), lose=P.realised_return(F.lit("draw"), F.lit("home_win"), l(2), l(3), l(4), l(10)),
              clv=P.closing_line_value(l(2.2), l(2)), bad=P.closing_line_value(l(2.2), l(1)))
    assert got["imp"] == 0.5 and got["none"] is None and got["bad"] is None
    assert got["k"] == pytest.approx(0.2) and got["ev"] == pytest.approx(0.2)
    assert (got["win"], got["lose"]) == (20.0, -10.0) and got["clv"] == pytest.approx(0.1)


def test_rank_buckets(spark):
    rows = spark.createDataFrame([(1,), (10,), (11,), (25,), (26,), (50,), (51,), (100,), (101,)], "r INT")
    assert [r[0] for r in rows.select(P.rank_bucket(F.col("r"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_metrics_closed_forms(spark):
    third = 1 / 3
    rows = spark.createDataFrame([("u", "draw", third, third, third), ("w", "away_win", 1.0, 0.0, 0.0)], "k STRING, actual STRING, p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE")
    got = {r["k"]: r for r in V.metrics(rows, ["k"]).collect()}
    assert got["u"]["log_loss"] == pytest.approx(math.log(3)) and got["u"]["brier"] == pytest.approx(2 / 3) and got["u"]["rps"] == pytest.approx(1 / 9)
    assert (got["w"]["accuracy"], got["w"]["brier"], got["w"]["rps"]) == (0.0, 2.0, 1.0)
    assert got["w"]["log_loss"] == pytest.approx(-math.log(1e-15))


def test_calibration_of_half_right_forecasts(spark):
    rows = spark.createDataFrame([("home_win", 0.8, 0.1, 0.1), ("draw", 0.8, 0.1, 0.1)], "actual STRING, p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE")
    bins = V.calibration_bins(rows, 5)
    hit = bins.filter("outcome = 'home_win' AND count > 0").first()
    assert hit["bin"] == 4 and hit["error"] == pytest.approx(-0.3)
    assert bins.count() == 15
    assert V.calibration_summary(bins).filter("outcome = 'home_win'").first()["ece"] == pytest.approx(0.3)


def test_unknown_place_gives_no_distance(spark):
    null = F.lit(None).cast("double")
    got = one(spark, a=S.great_circle_km(null, null, F.lit(1.0), F.lit(1.0)), b=S.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert got["a"] is None and got["b"] == pytest.approx(math.pi * S.EARTH_RADIUS_KM)


def test_text_rules(spark):
    rows = spark.createDataFrame([(" YES ", "3", "2024-05-01T12:00:00+02:00", "FT"), ("n", "2.5", "2024-05-01T12:00:00", "played"), ("?", "", "", "")], "b STRING, s STRING, t STRING, st STRING")
    got = rows.select(X.parse_bool("b").alias("b"), X.parse_score("s").alias("s"), X.score_is_invalid("s").alias("i"), X.parse_utc("t").cast("string").alias("t"),
                      X.map_status("st", {"ft": "completed"}, "scheduled").alias("st")).collect()
    assert [(r["b"], r["s"], r["i"], r["t"]) for r in got] == [(True, 3, False, "2024-05-01 10:00:00"), (False, None, True, None), (None, None, False, None)]
    assert [r["st"] for r in got] == ["completed", None, "scheduled"]


def test_unicode_names_fold_in_both_ways(spark):
    rows = spark.createDataFrame([("  Côte  D’Ivoire ",), ("ＴＥＡＭ  A",), ("Team  A",), ("Straße",), (None,)], "n STRING")
    got = {r["n"]: r["f"] for r in X.normalize_names(rows, "n", "f").collect()}
    assert got == {"  Côte  D’Ivoire ": "côte d’ivoire", "ＴＥＡＭ  A": "team a", "Team  A": "team a", "Straße": "strasse", None: None}


def test_fingerprint_ignores_row_order_and_sees_changes(spark):
    rows = [(i, f"x{i}", dt.date(2024, 1, 1 + i % 28)) for i in range(200)]
    make = lambda r, n: ids.fingerprint(spark.createDataFrame(r, "a INT, b STRING, c DATE").repartition(n), ["a", "b", "c"]).first()
    assert make(rows, 1) == make(rows[::-1], 7)
    assert make(rows, 3) != make([*rows[:-1], (199, "y", rows[-1][2])], 3)


@pytest.mark.parametrize("gender,level,official,want", [
    ("unknown", "youth", False, "review"), ("men", "unknown", True, "review"), ("men", "senior_a", None, "review"), ("women", "senior_a", True, "exclude"),
    ("men", "club", True, "exclude"), ("men", "senior_a", False, "exclude"), ("men", "senior_a", True, "include")])
def test_scope_rules_in_order(spark, gender, level, official, want):
    s = X.scope_decision(F.lit(gender), F.lit(level), F.lit(official).cast("boolean"))
    assert one(spark, s=s)["s"]["decision"] == want
