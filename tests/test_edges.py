"""Odd names, scores, dates and pools."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prematch import session
from prematch.functions import ids, text
from prematch.operators import entities, quality, ratings


def test_names_resolve_across_unicode_forms(spark):
    canonical = spark.createDataFrame([("Foo  Bar", 1), ("Straße", 2)], "name string, entity_id long")
    aliases = spark.createDataFrame([("Café", 3)], "label string, entity_id long")
    rows = spark.createDataFrame([("\tFoo Bar ",), ("Ｆｏｏ bar",), ("STRASSE",), ("Café",), ("other",), (None,)], "name string")
    got = {r["name"]: (r["id"], r["id_matched_by"]) for r in entities.resolve(rows, "name", canonical, aliases, "id").collect()}
    assert got == {"\tFoo Bar ": (1, "canonical_name"), "Ｆｏｏ bar": (1, "canonical_name"), "STRASSE": (2, "canonical_name"), "Café": (3, "alias"), "other": (None, None), None: (None, None)}
    twice = spark.createDataFrame([(1, "Ｆoo"), (2, "foo")], "entity_id long, name string")
    codes = {r.code for r in quality.catalog_violations(twice, aliases.limit(0)).collect()}
    assert codes == {"duplicate_name"}


def test_long_scores_are_invalid_not_fatal(spark):
    rows = spark.createDataFrame([("1e12",), ("1234567890123",), ("3",), ("",)], "s string")
    got = rows.select(text.parse_score("s").alias("v"), F.coalesce(text.score_is_invalid("s"), F.lit(False)).alias("bad")).collect()
    assert [(r.v, r.bad) for r in got] == [(None, True), (None, True), (3, False), (None, False)]


def test_rows_without_a_date_keep_their_id(spark):
    rows = [(1, None, 1, 2, "c", "normalized", ["ok"], "m1"), (2, None, 2, 1, "c", "normalized", ["ok"], "m2"), (3, dt.date(2020, 1, 1), 1, 2, "c", "normalized", ["ok"], "m3"), (4, dt.date(2020, 1, 1), 2, 1, "c", "normalized", ["ok"], "m4")]
    routed = spark.createDataFrame(rows, "row_no long, match_date date, home_id long, away_id long, competition_id string, decision string, reasons array<string>, match_id string")
    got = {r.row_no: (r.decision, r.match_id) for r in entities.quarantine_duplicates(routed, "row_no", "row_no").collect()}
    assert got == {1: ("normalized", "m1"), 2: ("normalized", "m2"), 3: ("normalized", "m3"), 4: ("quarantined", None)}


def test_fingerprint_uses_the_whole_hash(spark):
    row = ids.fingerprint(spark.range(50), ["id"]).first()
    assert row.row_count == 50 and len(row.content_sum.split("-")) == 8
    assert ids.fingerprint(spark.range(50).repartition(7), ["id"]).first().content_sum == row.content_sum


@pytest.mark.parametrize("limit", [10**9, 0])
def test_null_pools_and_repeated_ids(spark, limit):
    day = dt.date(2020, 1, 1)
    rows = [(1, "a", day, 1, 2, 2, 0), (1, None, day, 1, 2, 0, 1), (2, None, day + dt.timedelta(1), 2, 1, 1, 1), (3, "a", None, 1, 2, 1, 0)]
    matches = spark.createDataFrame(rows, "match_id long, p string, match_date date, home_id long, away_id long, home_score int, away_score int").withColumn("neutral", F.lit(False))
    got = ratings.elo_history(matches, F.col("p"), pool_rows=limit).collect()
    assert sorted((r["pool"], r.match_id) for r in got) == [("(none)", 1), ("(none)", 2), ("a", 1)]


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
