"""Chunked windows must equal the plain ones when one key holds most rows, whatever the chunk size."""

import random

import pytest
from pyspark.sql import functions as F

from prematch.operators import asof as A
from prematch.operators import skew


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = 1 if rng.random() < 0.6 else rng.randint(2, 9)
        t = rng.randint(0, 4000) if i % 3 else rng.randint(1000, 1010)  # bursts: many rows in few instants
        out.append((key, t, i, rng.random() if rng.random() < 0.7 else None, rng.randint(0, 50)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "k INT, t LONG, id INT, v DOUBLE, o INT")


@pytest.mark.parametrize("hot", [20, 75, 10_000])
def test_rolling_matches_brute_force(spark, data, hot):
    df = frame(spark, data)
    got = skew.rolling(df, ["k"], ["t", "id"], 5, F.col("t"), {"s": (F.sum("o"), -5, -1), "n": (F.count("*"), -3, -1)}, hot)
    want = {}
    for key in {r[0] for r in data}:
        seq = sorted([r for r in data if r[0] == key], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(seq):
            past = seq[max(0, i - 5):i]
            want[r[2]] = (sum(p[4] for p in past) if past else None, len(seq[max(0, i - 3):i]))
    rows = got.collect()
    assert len(rows) == len(data)
    assert {r["id"]: (r["s"], r["n"]) for r in rows} == want


@pytest.mark.parametrize("hot", [20, 75, 10_000])
def test_running_top_n_matches_brute_force(spark, data, hot):
    df = frame(spark, data).withColumn("x", F.when(F.col("v").isNotNull(), F.struct("o", "id")))
    got = skew.running_top_n(df, ["k"], ["t", "id"], "x", 4, F.col("t"), "top", hot)
    want = {}
    for key in {r[0] for r in data}:
        seq = sorted([r for r in data if r[0] == key], key=lambda r: (r[1], r[2]))
        for i, r in enumerate(seq):
            want[r[2]] = sorted([(p[4], p[2]) for p in seq[:i + 1] if p[3] is not None], reverse=True)[:4]
    rows = got.collect()
    assert len(rows) == len(data)
    assert {r["id"]: [tuple(x) for x in r["top"]] for r in rows} == want


@pytest.mark.parametrize("hot", [20, 75, 10_000])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_latest_matches_brute_force(spark, data, hot, strict):
    df = frame(spark, data).withColumn("at", F.timestamp_seconds("t"))
    left = df.filter("id % 2 = 0").select("k", "id", "at")
    right = df.filter("id % 2 = 1").select("k", F.col("id").alias("rid"), "at", "v")
    got = A.asof_latest(left, right, ["k"], "at", "at", ["rid"], ["rid"], strict, "o", hot)
    want = {}
    for r in data:
        if r[2] % 2 == 0:
            seen = [p for p in data if p[2] % 2 and p[0] == r[0] and (p[1] < r[1] or (p[1] == r[1] and not strict))]
            want[r[2]] = max(seen, key=lambda p: (p[1], p[2]))[2] if seen else None
    rows = got.collect()
    assert len(rows) == len(want)
    assert {r["id"]: (r["o"]["rid"] if r["o"] else None) for r in rows} == want


@pytest.mark.parametrize("hot", [20, 10_000])
def test_running_sum_matches_brute_force(spark, data, hot):
    df = frame(spark, data).withColumn("x", F.col("o").cast("double"))
    chunked, any_hot = skew.assign_chunks(df, ["k"], F.col("t"), hot)
    got = skew.running_sum(chunked, ["k"], ["t", "id"], "x", "s", skew.CHUNK if any_hot else None)
    want = {}
    for key in {r[0] for r in data}:
        total = 0
        for r in sorted([r for r in data if r[0] == key], key=lambda r: (r[1], r[2])):
            want[r[2]] = float(total)
            total += r[4]
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_hot_key_really_is_split(spark, data):
    chunked, any_hot = skew.assign_chunks(frame(spark, data), ["k"], F.col("t"), 50)
    assert any_hot
    assert chunked.filter("k = 1").select(skew.CHUNK).distinct().count() > 5
    assert chunked.filter("k = 3").select(skew.CHUNK).distinct().count() == 1


def test_running_top_n_of_a_large_key_needs_no_window(spark):
    """One key over many batches: the plan has no window that holds the key's rows, and only wanted rows come back."""
    n = 45_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id", F.when(F.col("id") % 3 > 0, F.struct((F.col("id") * 7919 % n).alias("o"), "id")).alias("x"))
    got = skew.running_top_n(df, ["k"], ["t", "id"], "x", 3, F.col("t"), "top", wanted=F.col("id") % 1000 == 999)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r["id"]: [x["o"] for x in r["top"]] for r in got.collect()}
    assert rows == {i: sorted([j * 7919 % n for j in range(i + 1) if j % 3], reverse=True)[:3] for i in range(999, n, 1000)}
