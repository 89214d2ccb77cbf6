"""Files in, tables out, streams into the record table."""

import json

import pytest
from pyspark.sql import functions as F

from prematch.plans import research
from prematch.sources import readers as R
from prematch.sources import writers as W
from prematch.streaming import ingest as I


def test_results_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\n2020-01-02, A ,B,2,1,Friendly,x,y,TRUE\n2020-01-03,A,A,1,1,Friendly,x,y,no\n")
    raw = R.read_text_csv(spark, str(path), R.RESULT_COLUMNS)
    got = R.historical_results(raw).orderBy("match_date").collect()
    assert (got[0]["home_team"], got[0]["outcome"], got[0]["neutral"], got[0]["violations"]) == ("A", "home_win", True, [])
    assert got[1]["violations"] == ["self_play"]


def test_missing_column_fails_the_read(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        R.preset_results(spark.createDataFrame([("2020-01-01",)], "date STRING"), "2024-01-01T00:00:00Z")


def test_catalog_and_membership_files(spark, tmp_path):
    (tmp_path / "teams.json").write_text(json.dumps({"teams": [{"team_id": "t1", "name": "One", "confederation": "UEFA"}, {"team_id": "t2", "name": "Two"}], "aliases": {"Uno": "t1"}}, indent=1))
    docs = R.read_catalog(spark, str(tmp_path / "teams.json"), R.TEAM_CATALOG)
    assert R.catalog_entries(docs, "teams").count() == 2
    assert [tuple(r) for r in R.catalog_aliases(docs).collect()] == [("Uno", "t1")]


@pytest.mark.parametrize("extra,want", [
    ({"kickoff_at": "2026-06-11T18:00:00Z"}, "2026-06-11T18:00:00Z"), ({"datetime": "2026-06-11 18:00"}, "2026-06-11T18:00:00Z"), ({"time": "18:00"}, "2026-06-11T18:00:00Z"), ({}, "")])
def test_fixture_kickoff_sources(spark, extra, want):
    row = {"date": "2026-06-11", "home_team": " Mexico ", "away_team": "X", "tournament": "FIFA World Cup", **extra}
    got = R.fixture_schedule(spark.createDataFrame([row])).first()
    assert (got["kickoff_at"], got["home_team"], got["status"], got["violations"]) == (want, "Mexico", "scheduled", [])


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_exports(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x INT, y STRING")
    W.export(df, str(tmp_path / fmt), fmt)
    reader = spark.read.option("header", True).schema(df.schema)
    assert sorted(tuple(r) for r in getattr(reader, fmt)(str(tmp_path / fmt)).select("x", "y").collect()) == [(1, "a"), (2, "b")]


def test_append_checks_the_schema_first(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        W.append(spark.createDataFrame([("a",)], "team STRING"), str(tmp_path / "p"), "player_availability")


def test_audit_lists_newest_first(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i, status in enumerate(["completed", "failed"]):
        row = spark.sql(f"SELECT 'r{i}' AS run_id, TIMESTAMP '2024-01-0{i + 1}' AS started_at, TIMESTAMP '2024-01-0{i + 1}' AS finished_at, '{status}' AS status, 1 AS row_count, '' AS message")
        W.append(row, path, "scheduled_runs")
    assert [r["run_id"] for r in W.newest_first(spark, path, "started_at", "run_id").collect()] == ["r1", "r0"]


def record_lines(numbers):
    line = lambda i: json.dumps({"sequence": i, "kind": "odds" if i % 2 else "match", "entity_id": str(i), "available_at": "2024-01-01T00:00:00Z", "recorded_at": "2024-01-02T00:00:00Z", "payload": "{}"})
    return "\n".join(map(line, numbers))


def ingest(spark, tmp_path):
    query = I.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "records"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    return query


def stored_ids(spark, tmp_path):
    return sorted(int(r["entity_id"]) for r in I.stored_records(spark, str(tmp_path / "records")).collect())


def test_stream_appends_each_record_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert stored_ids(spark, tmp_path) == []
    (tmp_path / "in" / "a.json").write_text(record_lines([0, 1, 2, 3, 4, 4]))
    ingest(spark, tmp_path)
    # a try of the second batch that was stopped before its commit: not seen, and replaced when the stream goes on
    half = I.stored_records(spark, str(tmp_path / "records")).withColumn("entity_id", F.lit("99"))
    half.write.partitionBy("kind").parquet(str(tmp_path / "records" / "data" / "batch=1"))
    assert stored_ids(spark, tmp_path) == [0, 1, 2, 3, 4]
    (tmp_path / "in" / "b.json").write_text(record_lines(range(3, 8)))
    query = ingest(spark, tmp_path)
    assert stored_ids(spark, tmp_path) == list(range(8))
    state = query.lastProgress["stateOperators"][0]
    assert any(k.startswith("rocksdb") for k in state["customMetrics"])
    assert not any("records" in s["description"] for s in query.lastProgress["sources"])  # the table is not read
    assert [(r.batch, r.rows) for r in I.commits(spark, str(tmp_path / "records")).orderBy("batch").collect()][:2] == [(0, 5), (1, 3)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "records")
    rows = spark.createDataFrame([(1, "odds", "1", "r1", None, None, "{}"), (2, "match", "2", "r2", None, None, None)], I.RECORD_SCHEMA)
    for _ in range(2):
        I.commit_batch(rows, 0, table)
    I.commit_batch(rows.limit(0), 1, table)
    assert stored_ids(spark, tmp_path) == [1, 2] and I.commits(spark, table).count() == 2


def test_scheduled_run_writes_an_audit_row_even_on_failure(spark, tmp_path):
    bad = spark.createDataFrame([(1,)], "match_id INT")
    ok = research.run_scheduled(bad, "2024-01-01T00:00:00Z", "2024-02-01", "m", str(tmp_path / "l"), str(tmp_path / "a"), "run-1")
    row = spark.read.parquet(str(tmp_path / "a")).first()
    assert not ok and (row["run_id"], row["status"], row["row_count"]) == ("run-1", "failed", 0) and row["message"]


def test_wide_to_long_skips_missing(spark):
    df = spark.createDataFrame([("a", "b", 1.0, None), ("a", "c", 2.0, 3.0)], "x STRING, y STRING, f DOUBLE, g DOUBLE")
    got = W.to_feature_store(df, ["x", "y"], ["f", "g"], "v", "t", F.lit("2024-01-01"))
    assert sorted((r["entity_id"], r["feature_name"], r["feature_value"]) for r in got.collect()) == [("a:b", "f", 1.0), ("a:c", "f", 2.0), ("a:c", "g", 3.0)]
