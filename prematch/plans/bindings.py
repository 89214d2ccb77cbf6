"""Views of the driver tables in the shapes the operators read, for Spark and (as text) for SQL checks.

Every view is a projection of one table with the same arithmetic in both engines; where date
functions differ the two spellings stand side by side. Views keep every row of their table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# name -> expression valid in both engines, or (Spark, SQL check)
_HOURS = ("timestampadd(HOUR, CAST({0} AS INT), CAST({1} AS TIMESTAMP))", "{1} + to_hours(CAST({0} AS BIGINT))")


def _plus_hours(ts: str, hours: str) -> tuple[str, str]:
    return _HOURS[0].format(hours, ts), _HOURS[1].format(hours, ts)


def _case(*parts) -> tuple[str, str]:
    """CASE from (condition, value) pairs and a final default; values may differ per engine."""
    def render(i: int) -> str:
        text = "CASE"
        for cond, value in parts[:-1]:
            text += f" WHEN {cond} THEN {value[i] if isinstance(value, tuple) else value}"
        last = parts[-1]
        return text + f" ELSE {last[i] if isinstance(last, tuple) else last} END"
    return render(0), render(1)


_HOME = "o_custkey % 97"
_AWAY = "(o_custkey % 97 + 1 + o_orderkey % 96) % 97"
TOURNAMENT = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'FIFA World Cup' WHEN '2-HIGH' THEN 'FIFA World Cup qualification' "
    "WHEN '3-MEDIUM' THEN 'UEFA Euro' WHEN '4-NOT SPECIFIED' THEN 'Friendly' ELSE 'Regional Cup' END"
)

VIEWS: dict[str, tuple[str, dict]] = {
    "matches": ("orders", {
        "match_id": "o_orderkey",
        "match_date": "CAST(o_orderdate AS DATE)",
        "kickoff_at": _case(("o_orderkey % 4 = 0", "NULL"), _plus_hours("o_orderdate", "o_orderkey % 22")),
        "home_id": _HOME,
        "away_id": _AWAY,
        "home_score": "CAST(floor(o_totalprice) AS BIGINT) % 5",
        "away_score": "CAST(floor(o_totalprice / 7) AS BIGINT) % 4",
        "neutral": "o_orderkey % 3 = 0",
        "competition_id": "o_orderpriority",
        "tournament": TOURNAMENT,
        "status": "CASE WHEN o_orderstatus = 'O' THEN 'scheduled' ELSE 'completed' END",
        "available_at": _case(
            ("o_orderkey % 5 = 0", "NULL"), ("o_orderkey % 41 = 0", _plus_hours("o_orderdate", "1")),
            _plus_hours("o_orderdate", "23 + o_orderkey % 200")),
    }),
    "raw_results": ("orders", {
        "row_no": "o_orderkey",
        "date": "CASE WHEN o_orderkey % 211 = 0 THEN 'soon' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END",
        "home_team": f"CASE WHEN o_orderkey % 97 = 13 THEN '  ' ELSE ' Team  ' || CAST({_HOME} AS VARCHAR(10)) || ' ' END",
        "away_team": f"'TEAM ' || CAST({_AWAY} AS VARCHAR(10))",
        "home_score": "CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 53 = 0 THEN '2.5' "
                      "ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS VARCHAR(10)) END",
        "away_score": "CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN '-1' "
                      "ELSE CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS VARCHAR(10)) END",
        "tournament": TOURNAMENT,
        "neutral": "CASE o_orderkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' no ' WHEN 2 THEN '1' WHEN 3 THEN 'Y' "
                   "WHEN 4 THEN 'false' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'maybe' ELSE '0' END END",
        "status": "CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'FT' WHEN o_orderstatus = 'P' "
                  "THEN 'Completed' ELSE 'abandoned' END",
        "score_basis": "CASE o_orderkey % 4 WHEN 0 THEN 'regulation_time' WHEN 1 THEN '' WHEN 2 THEN 'after_extra_time' "
                       "ELSE 'guess' END",
        "kickoff_text": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || "
                        "'T18:30:00Z' WHEN 2 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || 'T18:30:00' "
                        "ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || 'T18:30:00+02:00' END",
        "gender": "CASE o_orderkey % 11 WHEN 0 THEN 'women' WHEN 1 THEN 'unknown' ELSE 'men' END",
        "team_level": "CASE o_orderkey % 13 WHEN 0 THEN 'youth' WHEN 1 THEN 'unknown' ELSE 'senior_a' END",
        "official": "CASE o_orderkey % 17 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END",
    }),
    "observations": ("events", {
        "record_id": "event_id",
        "team_id": "user_id % 97",
        "source": "event_type",
        "available_at": ("CAST(ts AS TIMESTAMP)", "ts"),
        "leakage_risk": "CASE WHEN event_type = 'error' THEN 'high' ELSE 'safe' END",
        "value": "value",
        "rank": "1 + CAST(floor(value) AS BIGINT) % 150",
        "points": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE 1000 + value END",
        "home_odds": "1.05 + value / 50",
        "draw_odds": "2.5 + value / 100",
        "away_odds": "1.2 + 100 / (1 + value)",
        "lat": "(CAST(floor(value * 100) AS BIGINT) % 18000) / 100e0 - 90e0",
        "lon": "(CAST(floor(value * 100) AS BIGINT) % 36000) / 100e0 - 180e0",
        "props": "props",
    }),
    "predictions": ("lineitem", {
        "row_id": "l_orderkey * 10 + l_linenumber",
        "match_id": "l_orderkey",
        "prediction_time": ("CAST(l_shipdate AS TIMESTAMP)", "l_shipdate"),
        "model_id": "l_linestatus",
        "p_home": "(1 + l_quantity) / (3 + l_quantity + l_discount * 100 + l_tax * 500)",
        "p_draw": "(1 + l_discount * 100) / (3 + l_quantity + l_discount * 100 + l_tax * 500)",
        "p_away": "(1 + l_tax * 500) / (3 + l_quantity + l_discount * 100 + l_tax * 500)",
        "actual": "CASE l_returnflag WHEN 'A' THEN 'home_win' WHEN 'N' THEN 'draw' ELSE 'away_win' END",
        "q_home": "(2 + l_tax * 500) / (6 + l_quantity / 5 + l_discount * 100 + l_tax * 500)",
        "q_draw": "(2 + l_quantity / 5) / (6 + l_quantity / 5 + l_discount * 100 + l_tax * 500)",
        "q_away": "(2 + l_discount * 100) / (6 + l_quantity / 5 + l_discount * 100 + l_tax * 500)",
        "home_odds": "1.1 + l_extendedprice / 20000",
        "draw_odds": "2.0 + l_quantity / 20",
        "away_odds": "1.3 + l_discount * 40 + l_tax * 10",
        "home_id": "l_suppkey % 97",
        "away_id": "(l_suppkey + 1 + l_partkey % 96) % 97",
    }),
    "forecasts": ("orders", {
        "match_id": "o_orderkey",
        "p_home": "(1 + o_custkey % 7) / (3e0 + o_custkey % 7 + o_orderkey % 5 + CAST(floor(o_totalprice) AS BIGINT) % 6)",
        "p_draw": "(1 + o_orderkey % 5) / (3e0 + o_custkey % 7 + o_orderkey % 5 + CAST(floor(o_totalprice) AS BIGINT) % 6)",
        "p_away": "(1 + CAST(floor(o_totalprice) AS BIGINT) % 6) / (3e0 + o_custkey % 7 + o_orderkey % 5 + CAST(floor(o_totalprice) AS BIGINT) % 6)",
    }),
    "quotes": ("lineitem", {
        "match_id": "l_orderkey",
        "bookmaker": "'B' || CAST(l_linenumber % 3 AS VARCHAR(10))",
        "record_id": "l_orderkey * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000",
        "available_at": _plus_hours("l_shipdate", "0 - 24 * (l_partkey % 60)"),
        "leakage_risk": "CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'safe' END",
        "score_basis": "CASE WHEN l_linestatus = 'F' THEN 'regulation_time' ELSE 'unknown' END",
        "home_odds": "1.1 + l_extendedprice / 20000",
        "draw_odds": "2.0 + l_quantity / 20",
        "away_odds": "1.3 + l_discount * 40 + l_tax * 10",
    }),
    "players": ("lineitem", {
        "match_id": "l_orderkey",
        "side": "CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END",
        "player_id": "l_suppkey % 11",
        "team": "'T' || CAST(l_suppkey % 97 AS VARCHAR(10))",
        "record_id": "l_partkey * 1000 + l_linenumber * 100 + l_suppkey % 100",
        "available_at": _plus_hours("l_shipdate", "0 - 24 * (l_partkey % 60)"),
        "leakage_risk": "CASE WHEN l_returnflag = 'R' THEN 'review' ELSE 'safe' END",
        "probability": "l_discount * 10",
        "minutes": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 1.8 END",
        "importance": "l_tax * 100 - 1",
        "status_text": "CASE l_linenumber WHEN 1 THEN 'Available' WHEN 2 THEN ' doubtful' WHEN 3 THEN 'OUT' "
                       "WHEN 4 THEN 'suspended' WHEN 5 THEN 'limited' WHEN 6 THEN 'fit' ELSE 'on holiday' END",
    }),
    "records": ("lineitem", {
        "sequence": "l_orderkey * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 10000000",
        "kind": "CASE l_returnflag WHEN 'A' THEN 'match' WHEN 'N' THEN 'forecast' ELSE 'odds' END",
        "entity_id": "l_partkey",
        "available_at": ("CAST(l_shipdate AS TIMESTAMP)", "l_shipdate"),
        "recorded_at": _plus_hours("l_shipdate", "l_linenumber * 7"),
        "payload": "'{\"quantity\":' || CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) || ',\"line\":' "
                   "|| CAST(l_linenumber AS VARCHAR(10)) || '}'",
        "line": "l_linenumber",
        "price": "l_extendedprice",
    }),
}

# Prediction rows repeat (match, model); the deduplicated view keeps the last in a total order.
SQL_DEDUPED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, model_id ORDER BY prediction_time DESC,
  p_home DESC, p_draw DESC, actual DESC, home_odds DESC, q_home DESC) AS rn FROM predictions) WHERE rn = 1"""


def sql_view(name: str) -> str:
    table, columns = VIEWS[name]
    body = ", ".join(f"{e[1] if isinstance(e, tuple) else e} AS {n}" for n, e in columns.items())
    return f"SELECT {body} FROM {table}"


def ctes(*names: str) -> str:
    """WITH clause that defines the named views for a check query."""
    parts = []
    for name in names:
        if name == "scored":
            parts.append(f"scored AS ({SQL_DEDUPED})")
        elif name == "eligible":
            parts.append(f"eligible AS ({SQL_ELIGIBLE})")
        elif name == "sides":
            parts.append(f"sides AS ({SQL_SIDES})")
        else:
            parts.append(f"{name} AS ({sql_view(name)})")
    return "WITH " + ", ".join(parts)


# Independent spelling of eligibility and cutoff for the checks (needs the matches view).
SQL_ELIGIBLE = """SELECT *, CASE WHEN kickoff_at IS NOT NULL THEN kickoff_at
    ELSE CAST(match_date AS TIMESTAMP) - INTERVAL 1 MICROSECOND END AS prediction_time,
  CASE WHEN status <> 'completed' THEN NULL
    WHEN kickoff_at IS NOT NULL AND available_at IS NULL THEN CAST(CAST(kickoff_at AS DATE) + 1 AS TIMESTAMP)
    WHEN kickoff_at IS NOT NULL AND available_at <= kickoff_at THEN NULL
    WHEN kickoff_at IS NOT NULL THEN available_at
    ELSE greatest(CAST(match_date + 1 AS TIMESTAMP), coalesce(available_at, CAST(match_date + 1 AS TIMESTAMP)))
    END AS eligible_at FROM matches"""
SQL_SIDES = """SELECT match_id, match_date, kickoff_at, prediction_time, eligible_at, status, competition_id, neutral, 'home' AS side,
    home_id AS team_id, away_id AS opponent_id, home_score AS gf, away_score AS ga FROM eligible
  UNION ALL SELECT match_id, match_date, kickoff_at, prediction_time, eligible_at, status, competition_id, neutral, 'away',
    away_id, home_id, away_score, home_score FROM eligible"""


class Tables:
    """The driver tables of one folder and the views above, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        table, columns = VIEWS[name]
        return self.raw(table).selectExpr(
            *[f"{e[0] if isinstance(e, tuple) else e} AS {n}" for n, e in columns.items()]
        )

    @cached_property
    def matches(self) -> DataFrame:
        return self.view("matches")

    @cached_property
    def observations(self) -> DataFrame:
        return self.view("observations")

    @cached_property
    def predictions(self) -> DataFrame:
        return self.view("predictions")

    @cached_property
    def players(self) -> DataFrame:
        return self.view("players")

    @cached_property
    def records(self) -> DataFrame:
        return self.view("records")

    @cached_property
    def eligible(self) -> DataFrame:
        from ..operators.history import with_cutoff, with_eligibility

        return with_cutoff(with_eligibility(self.matches))

    @cached_property
    def scored(self) -> DataFrame:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        order = ["prediction_time", "p_home", "p_draw", "actual", "home_odds", "q_home"]
        w = Window.partitionBy("row_id", "model_id").orderBy(*[F.col(c).desc() for c in order])
        return self.predictions.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
