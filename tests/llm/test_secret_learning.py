import random

import numpy as np

from prematch.llm import secret_scan

LABELS = "row_key string, cand array<struct<start:int,stop:int,label:boolean,seen:string>>"


def found_of(spark, n, secret, parts=3):
    rng, rows = random.Random(5), []
    for i in range(n):
        word = "".join(rng.choice("abcdef0123456789") if secret(i) else rng.choice("ghijklmnop") for _ in range(20))
        rows.append((f"r{i}", [(0, 20, secret(i), secret_scan.window(word, 0, 20))]))
    return spark.createDataFrame(rows, LABELS).repartition(parts)


def test_every_labelled_candidate_is_learned_from_or_held_out(spark, monkeypatch):
    seen = {}
    trained, calibrated = secret_scan._trained, secret_scan._calibrated
    monkeypatch.setattr(secret_scan, "_trained", lambda rows, secrets, others: seen.update(trained=rows.count(), counts=secrets + others) or trained(rows, secrets, others))
    monkeypatch.setattr(secret_scan, "_calibrated", lambda held: seen.update(held=held.count()) or calibrated(held))
    model = secret_scan.fit(found_of(spark, 9000, lambda i: i % 2 == 0))
    assert seen["trained"] + seen["held"] == 9000 and seen["counts"] == seen["trained"] and 0.15 < seen["held"] / 9000 < 0.25
    assert model["false_positive_rate"] < 0.05


def test_tasks_together_learn_rare_secrets_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD", 700)
    a, b = (secret_scan.fit(found_of(spark, 4000, lambda i: i % 40 == 0, parts)) for parts in (2, 5))
    assert np.array_equal(a["net"].vector(), b["net"].vector()) and a["threshold"] == b["threshold"]
    assert a["false_positive_rate"] < 0.02


def test_quantile_and_calibration_equal_those_in_memory(spark):
    rng = np.random.default_rng(2)
    label = rng.random(500) < 0.4
    logit = (rng.normal(size=500) + label - 0.3).astype(np.float32)
    rows = spark.createDataFrame([(bool(y), float(z)) for y, z in zip(label, logit)], "label boolean, logit float")
    for q in (0.0, 0.05, 0.5, 0.93, 1.0):
        assert secret_scan._lower_quantile(rows, q) == np.quantile(logit, q, method="lower")
    assert np.allclose(secret_scan._calibrated(rows), secret_scan.calibrate(logit, label.astype(float)), atol=1e-6)
