"""Boundaries: what exactly may a row know at its own cutoff."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prematch.operators import asof as A
from prematch.operators import bitemporal as B
from prematch.operators import features as X
from prematch.operators import history as H

T = lambda *a: dt.datetime(*a)
MATCH = "match_id LONG, match_date DATE, kickoff_at TIMESTAMP, home_id STRING, away_id STRING, home_score INT, away_score INT, status STRING, available_at TIMESTAMP, neutral BOOLEAN"


def matches(spark, rows):
    return H.with_cutoff(H.with_eligibility(spark.createDataFrame(rows, MATCH)))


def demo(spark):
    return matches(spark, [
        (1, dt.date(2026, 5, 1), T(2026, 5, 1, 18), "ARG", "BRA", 2, 0, "completed", T(2026, 5, 1, 21), False),
        (2, dt.date(2026, 5, 10), T(2026, 5, 10, 18), "FRA", "ARG", 1, 1, "completed", T(2026, 5, 10, 21), False),
        (3, dt.date(2026, 5, 20), T(2026, 5, 20, 18), "ARG", "URU", 0, 4, "completed", T(2026, 5, 20, 21), False),
        (4, dt.date(2026, 5, 15), T(2026, 5, 15, 12), "ARG", "FRA", None, None, "scheduled", None, False),
    ])


def test_form_uses_eligible_matches_only(spark):
    m = demo(spark)
    got = X.form(H.recent_history(m, 5), (5,)).filter("match_id = 4 AND side = 'home'").first()
    assert (got["used_5"], got["points_5"], got["goal_diff_5"], got["goals_for_5"], got["goals_against_5"]) == (2, 2.0, 1.0, 1.5, 0.5)


def test_later_results_do_not_change_earlier_features(spark):
    m = demo(spark)
    before = X.form(H.recent_history(m, 5), (5,)).filter("match_id = 4").orderBy("side").collect()
    more = m.unionByName(matches(spark, [(9, dt.date(2026, 6, 1), T(2026, 6, 1, 18), "ARG", "FRA", 5, 0, "completed", T(2026, 6, 1, 21), False)]))
    after = X.form(H.recent_history(more, 5), (5,)).filter("match_id = 4").orderBy("side").collect()
    assert before == after


def test_late_publication_reorders_eligibility_not_history(spark):
    # the earlier match is published last; it still ranks behind the later one
    m = matches(spark, [
        (1, dt.date(2026, 1, 1), T(2026, 1, 1, 12), "A", "B", 1, 0, "completed", T(2026, 2, 1), False),
        (2, dt.date(2026, 1, 5), T(2026, 1, 5, 12), "A", "C", 0, 3, "completed", T(2026, 1, 6), False),
        (3, dt.date(2026, 1, 20), T(2026, 1, 20, 12), "A", "D", None, None, "scheduled", None, False),
        (4, dt.date(2026, 2, 1), T(2026, 2, 1), "A", "D", None, None, "scheduled", None, False),
    ])
    h = {(r["match_id"], r["side"]): [x["m"] for x in r["history"]] for r in H.recent_history(m, 2).collect()}
    assert h[(3, "home")] == [2]
    assert h[(4, "home")] == [2, 1]  # published exactly at the cutoff counts
    assert h[(1, "home")] == []


def test_chunked_history_is_the_same(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(240):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 120))
        kick = None if i % 4 == 0 else dt.datetime.combine(day, dt.time(rng.randint(0, 23)))
        pub = None if i % 5 == 0 else dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1 + rng.randint(0, 15))
        other = rng.choice("BCDEF")
        rows.append((i, day, kick, "A" if i % 3 else other, "Z" if i % 3 else "A", rng.randint(0, 4), rng.randint(0, 4), "completed", pub, False))
    m = matches(spark, rows)
    key = lambda df: {(r["match_id"], r["side"]): [x["m"] for x in r["history"]] for r in df.collect()}
    plain, split = key(H.recent_history(m, 6)), key(H.recent_history(m, 6, hot_rows=40))
    assert plain == split and len(plain) == 480


@pytest.mark.parametrize("kickoff,available,want,violation", [
    (T(2026, 5, 1, 18), None, T(2026, 5, 2), None), (T(2026, 5, 1, 18), T(2026, 5, 1, 20), T(2026, 5, 1, 20), None),
    (T(2026, 5, 1, 18), T(2026, 5, 1, 18), None, "available_not_after_kickoff"), (None, None, T(2026, 5, 2), None),
    (None, T(2026, 5, 1, 20), T(2026, 5, 2), None), (None, T(2026, 5, 3, 1), T(2026, 5, 3, 1), None), (None, T(2026, 4, 30), None, "available_before_match_date")])
def test_result_eligibility(spark, kickoff, available, want, violation):
    r = matches(spark, [(1, dt.date(2026, 5, 1), kickoff, "A", "B", 1, 0, "completed", available, False)]).first()
    assert (r["eligible_at"], r["eligibility_violation"]) == (want, violation)


def test_asof_reasons(spark):
    left = spark.createDataFrame([("a", T(2024, 1, 10)), ("b", T(2024, 1, 10)), ("c", T(2024, 1, 10)), ("d", T(2024, 1, 10)), ("e", T(2024, 1, 10))], "k STRING, t TIMESTAMP")
    right = spark.createDataFrame([
        ("a", 1, T(2024, 1, 10), "safe"), ("a", 2, T(2024, 1, 10, 0, 0, 1), "safe"), ("b", 3, T(2024, 1, 1), "high"), ("c", 4, T(2023, 1, 1), "safe"), ("e", 5, None, "safe")],
        "k STRING, record_id INT, available_at TIMESTAMP, leakage_risk STRING")
    got = {r["k"]: (r["obs"]["record_id"] if r["obs"] else None, r["obs_reason"]) for r in
           A.asof_with_reason(left, right, ["k"], "t", ["record_id"], ["record_id"], 30).collect()}
    assert got == {"a": (1, None), "b": (None, A.INTEGRITY), "c": (None, A.STALE), "d": (None, A.UPSTREAM), "e": (None, A.INTEGRITY)}


def test_membership_uses_the_latest_published_release(spark):
    facts = spark.createDataFrame([("x", dt.date(2024, 3, 1), T(2024, 2, 1)), ("x", dt.date(2024, 3, 1), T(2024, 4, 1)), ("y", dt.date(2024, 3, 1), T(2024, 4, 1))], "team STRING, d DATE, t TIMESTAMP")
    p = lambda v, a, b: (v, a, b)
    rel = spark.createDataFrame([
        ("x", "r1", T(2024, 1, 1), [p("UEFA", dt.date(2000, 1, 1), dt.date(2024, 3, 1)), p("AFC", dt.date(2024, 3, 1), None)]),
        ("x", "r2", T(2024, 3, 15), [p("OFC", dt.date(2024, 3, 2), None)])],
        "team STRING, release_id STRING, available_at TIMESTAMP, periods ARRAY<STRUCT<value: STRING, valid_from: DATE, valid_to: DATE>>")
    got = {(r["team"], r["t"]): (r["member"], r["member_release"]) for r in A.interval_as_of(facts, rel, ["team"], "d", "t").collect()}
    assert got == {("x", T(2024, 2, 1)): ("AFC", "r1"), ("x", T(2024, 4, 1)): (None, "r2"), ("y", T(2024, 4, 1)): (None, None)}


def test_bitemporal_winner_is_by_recording_not_publication(spark):
    rec = spark.createDataFrame([
        (1, "m", "e", T(2024, 1, 9), T(2024, 1, 10), "{\"v\":1}"), (2, "m", "e", T(2024, 1, 1), T(2024, 1, 20), "{\"v\":2}"), (3, "m", "e", T(2024, 1, 1), T(2024, 2, 1), "{\"v\":3}")],
        "sequence LONG, kind STRING, entity_id STRING, available_at TIMESTAMP, recorded_at TIMESTAMP, payload STRING")
    assert B.latest_as_of(rec, "2024-01-25").first()["sequence"] == 2
    assert B.latest_as_of(rec, "2024-01-25", 1).first()["sequence"] == 1
    assert B.latest_as_of(rec, "2024-01-05").count() == 0


def test_append_is_idempotent_and_audit_finds_tampering(spark):
    rec = spark.createDataFrame([(i, "m", f"e{i % 3}", T(2024, 1, 1), T(2024, 1, 2), f'{{"v":{i // 2}}}') for i in range(6)],
                                "sequence LONG, kind STRING, entity_id STRING, available_at TIMESTAMP, recorded_at TIMESTAMP, payload STRING")
    addressed = rec.withColumn("record_id", B.record_id())
    assert B.new_records(addressed, addressed).count() == 0
    assert B.new_records(addressed.unionByName(addressed), addressed.limit(0)).count() == addressed.select("record_id").distinct().count()
    assert B.integrity_mismatches(addressed).count() == 0
    assert B.integrity_mismatches(addressed.withColumn("payload", F.lit("{}"))).count() == 6


def test_lineage_leak_is_found(spark):
    m = demo(spark)
    feats = spark.createDataFrame([(4, T(2026, 5, 15, 12), [1, 2]), (5, T(2026, 5, 15, 12), [3])], "match_id LONG, prediction_time TIMESTAMP, lineage ARRAY<LONG>")
    assert [(r["match_id"], r["reference"]) for r in A.lineage_leaks(feats, m).collect()] == [(5, 3)]
