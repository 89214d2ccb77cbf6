"""What the steps of exact quantiles and of drift send where, judged by their plans."""

import random

import numpy as np
from pyspark.sql import functions as F

from prematch.operators import evaluation as V
from prematch.operators import quantiles as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def values(spark):
    draw = random.Random(5)
    rows = [("a", draw.gauss(0, 1)) for _ in range(3000)] + [("b", float(draw.randrange(5))) for _ in range(1000)] + [("c", 7.0)] + [("d", None)]
    return spark.createDataFrame(rows, "feature STRING, value DOUBLE")


def test_ranks_are_not_carried_by_the_rows(spark):
    df, probs = values(spark), [i / 64 for i in range(1, 64)]
    found = Q.exact_quantiles(df, "feature", "value", probs)
    assert "SortAggregate" not in plan(found)  # rows with arrays of ranks cannot be counted by hash
    got = {r["feature"]: r["quantiles"] for r in found.collect()}
    assert sorted(got) == ["a", "b", "c"]
    for name in got:
        assert np.allclose(got[name], np.quantile([r["value"] for r in df.filter(F.col("feature") == name).collect()], probs), rtol=0, atol=1e-12)


def test_drift_does_not_shuffle_rows_by_feature(spark):
    df = values(spark).filter("feature < 'c'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(V.feature_drift(df, df.withColumn("value", F.col("value") + 1)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    union = next(i for i, line in enumerate(text.splitlines()) if "Union" in line)
    above = [line for line in text.splitlines()[:union] if "Join" in line]
    assert above and "BroadcastHashJoin" in above[-1]
