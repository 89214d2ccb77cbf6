import shutil

import pytest
from pyspark.sql import functions as F

from prematch.sources import publish as P

SCHEMAS = {"a": "k LONG, v STRING, at TIMESTAMP", "b": "x DOUBLE"}


def tables(spark, n):
    return {"a": spark.createDataFrame([(i, None if i % 3 else f"v{i}", None) for i in range(n)], SCHEMAS["a"]), "b": spark.createDataFrame([(0.1 * i,) for i in range(n + 1)], SCHEMAS["b"])}


def content(got):
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in got.items()}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_reader_sees_the_newest_whole_release(spark, tmp_path, fmt):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="Nothing"):
        P.read_release(spark, root, SCHEMAS)
    first = P.publish(tables(spark, 5), root, fmt=fmt)
    second = P.publish(tables(spark, 0), root, fmt=fmt)
    assert content(P.read_release(spark, root, SCHEMAS, verify=True)) == content(tables(spark, 0))
    assert content(P.read_release(spark, root, SCHEMAS, first, verify=True)) == content(tables(spark, 5))
    assert {r.release_id for r in P.releases(spark, root).collect()} == {first, second}
    with pytest.raises(ValueError, match="no release"):
        P.read_release(spark, root, SCHEMAS, "x")


def test_a_killed_export_is_invisible(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    P.publish(tables(spark, 3), root)
    broken = {"a": tables(spark, 9)["a"], "b": tables(spark, 9)["b"].select(F.raise_error(F.lit("killed")).cast("double").alias("x"))}
    with pytest.raises(Exception, match="killed"):
        P.publish(broken, root)
    assert content(P.read_release(spark, root, SCHEMAS, verify=True)) == content(tables(spark, 3))
    assert P.releases(spark, root).count() == 2


def test_a_changed_table_is_noticed(spark, tmp_path):
    root = str(tmp_path)
    P.publish(tables(spark, 4), root)
    where = P.releases(spark, root).filter("table_name = 'b'").first()["location"]
    shutil.rmtree(where)
    spark.createDataFrame([(9.0,)], SCHEMAS["b"]).write.parquet(where)
    with pytest.raises(ValueError, match="not what was published"):
        P.read_release(spark, root, SCHEMAS, verify=True)


def test_fingerprints_ignore_order_and_tell_rows_apart(spark):
    df = tables(spark, 6)["a"]
    mark = lambda d: d.agg(P.fingerprint(d)).first()[0]
    assert mark(df) == mark(df.orderBy(F.desc("k")).repartition(3))
    assert len({mark(df), mark(df.limit(5)), mark(df.unionByName(df.limit(1))), mark(df.withColumn("v", F.lit(None).cast("string"))), mark(df.withColumnRenamed("v", "w"))}) == 5
