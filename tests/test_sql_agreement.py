"""Queries against their SQL on rows that small tables do not hold."""

import datetime as dt

import pytest

from prematch.plans import check, registry

ORDERS = "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
LINES = ("l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
         "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ")
DAY = dt.datetime(1996, 3, 1)


@pytest.fixture
def folder(spark, tmp_path):
    registry.load()

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/parts/{name}")
            next((tmp_path / "parts" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
        return str(tmp_path)
    return write


@pytest.mark.parametrize("name", ["a12_export_roundtrip", "c4_duplicate_quarantine", "c5_split_outputs", "c6_quality_report", "c6_quality_issues"])
def test_rows_without_a_date_are_nobodys_copies(spark, folder, name):
    same = [k for k in range(211 * 96, 9_000_000, 211 * 96) if k % 11 > 1 and k % 13 > 1 and k % 17 > 1][:3]  # no date, the same teams
    where = folder(orders=([(k, 5, "F", 10.0, DAY, "1-URGENT") for k in same], ORDERS),
                   customer=([(k,) for k in range(97)], "c_custkey LONG"))
    ok, text = check.compare(spark, where, name)
    assert ok, text
    if name == "c6_quality_report":
        assert registry.QUERIES[name](spark, where).first()["normalized"] == 3


def test_strictly_earlier_date_of_large_record_ids(spark, folder):
    rows = [(2_500_000, 1, dt.datetime(2024, 1, 1, 5), "view", 1.0, "{}"), (3_999_999, 1, dt.datetime(2024, 1, 2, 5), "view", 1.0, "{}"),
            (4_000_001, 1, dt.datetime(2024, 1, 2, 4), "view", 1.0, "{}"), (5_000_000, 1, dt.datetime(2024, 1, 3, 5), "purchase", 1.0, "{}")]
    where = folder(events=(rows, "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE, props STRING"))
    ok, text = check.compare(spark, where, "d8_strictly_earlier_date")
    assert ok, text
    assert registry.QUERIES["d8_strictly_earlier_date"](spark, where).first()["record_id"] == 4_000_001


def test_reference_to_a_record_stored_twice_is_resolved_once(spark, folder):
    line = lambda part: (3, part, 1, 1, 2.0, 10.0, 0.0, 0.0, "N", "O", dt.datetime(1995, 1, 5))
    where = folder(lineitem=([line(8), line(8), line(9)], LINES))  # two copies, and another record under their sequence
    ok, text = check.compare(spark, where, "d15_lineage_resolution")
    assert ok, text
    assert registry.QUERIES["d15_lineage_resolution"](spark, where).count() == 3
