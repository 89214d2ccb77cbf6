"""As-of, history and bitemporal reads (D*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions.common import epoch, micros, r6
from ..operators import asof as A
from ..operators import bitemporal as B
from ..operators import history as H
from .bindings import SQL_ELIGIBLE, Tables, ctes
from .registry import query

ELIG = ctes("matches", "eligible")
SIDES = ctes("matches", "eligible", "sides")
OBS = ctes("observations")
REC = ctes("records")
SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"
# Readers are purchase events, each with its own time as cutoff; the other events are what they may see.
READERS = OBS + """, reader AS (SELECT record_id AS reader_id, team_id, available_at AS prediction_time FROM observations WHERE source = 'purchase'),
   shown AS (SELECT * REPLACE (CASE WHEN team_id = 13 THEN -13 ELSE team_id END AS team_id) FROM observations WHERE source <> 'purchase')"""


def readers(t: Tables):
    return t.observations.filter("source = 'purchase'").select(
        F.col("record_id").alias("reader_id"), "team_id", F.col("available_at").alias("prediction_time"))


def shown(t: Tables):
    # one team's observations stand under an id that no reader asks for
    return t.observations.filter("source <> 'purchase'").withColumn("team_id", F.when(F.col("team_id") == 13, -F.col("team_id")).otherwise(F.col("team_id")))


@query("d1_result_eligibility", f"""{ELIG} SELECT match_id, {SECONDS.format('eligible_at')} AS eligible_at,
   CASE WHEN eligible_at IS NULL THEN NULL WHEN available_at IS NOT NULL AND (kickoff_at IS NOT NULL OR available_at > CAST(match_date + 1 AS TIMESTAMP)) THEN 'source_available_at'
     ELSE 'conservative_next_utc_day' END AS basis,
   CASE WHEN status = 'completed' AND kickoff_at IS NOT NULL AND available_at <= kickoff_at THEN 'available_not_after_kickoff' END AS violation FROM eligible""")
def d1(t: Tables):
    return H.with_eligibility(t.matches).select("match_id", epoch("eligible_at").alias("eligible_at"), F.col("eligibility_basis").alias("basis"),
                                                F.col("eligibility_violation").alias("violation"))


@query("d2_eligible_before_cutoff", f"{ELIG} SELECT match_id FROM eligible WHERE eligible_at <= TIMESTAMP '1998-06-01 12:00:00'")
def d2(t: Tables):
    return H.eligible_before(t.eligible, "1998-06-01T12:00:00Z").select("match_id")


@query("d3_team_history", f"""{SIDES} SELECT team_id, match_id, side, opponent_id, gf AS goals_for, ga AS goals_against, CAST(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS INTEGER) AS points
   FROM sides WHERE eligible_at <= TIMESTAMP '1998-06-01 12:00:00'""")
def d3(t: Tables):
    return H.team_rows(H.eligible_before(t.eligible, "1998-06-01T12:00:00Z")).select(
        "team_id", "match_id", "side", "opponent_id", "goals_for", "goals_against", "points")


@query("d4_prediction_cutoff", f"""{ctes("matches")} SELECT match_id, {SECONDS.format("CASE WHEN kickoff_at IS NOT NULL THEN kickoff_at - INTERVAL 90 MINUTE ELSE CAST(match_date - 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND END")} AS prediction_time FROM matches""")
def d4(t: Tables):
    return H.with_cutoff(t.matches, 90, 2).select("match_id", epoch("prediction_time").alias("prediction_time"))


@query("d5_latest_as_of", f"""{READERS}, best AS (SELECT r.reader_id, arg_max(s.record_id, (s.available_at, s.record_id)) AS record_id FROM reader r JOIN shown s
     ON r.team_id = s.team_id AND s.available_at <= r.prediction_time AND s.leakage_risk = 'safe' GROUP BY r.reader_id)
   SELECT r.reader_id, CASE WHEN r.prediction_time - s.available_at > INTERVAL 2 DAY THEN NULL ELSE s.record_id END AS record_id,
     CASE WHEN s.record_id IS NOT NULL AND r.prediction_time - s.available_at <= INTERVAL 2 DAY THEN NULL WHEN s.record_id IS NOT NULL THEN 'stale'
       WHEN r.team_id IN (SELECT team_id FROM shown) THEN 'temporal_integrity' ELSE 'upstream_unavailable' END AS reason
   FROM reader r LEFT JOIN best b ON r.reader_id = b.reader_id LEFT JOIN shown s ON b.record_id = s.record_id""")
def d5(t: Tables):
    joined = A.asof_with_reason(readers(t), shown(t), ["team_id"], "prediction_time", ["record_id"], ["record_id"], 2)
    return joined.select("reader_id", F.col("obs.record_id").alias("record_id"), F.col("obs_reason").alias("reason"))


@query("d6_latest_per_subkey", f"""{OBS}, c AS (SELECT *, TIMESTAMP '2024-01-10 00:00:00' + to_hours(team_id) AS cutoff FROM observations)
   SELECT team_id, source, arg_max(record_id, (available_at, record_id)) AS record_id FROM c WHERE leakage_risk = 'safe' AND available_at <= cutoff GROUP BY team_id, source""")
def d6(t: Tables):
    c = t.observations.withColumn("cutoff", F.expr("timestampadd(HOUR, CAST(team_id AS INT), TIMESTAMP '2024-01-10 00:00:00')"))
    return A.latest_per_as_of(c, ["team_id", "source"], "cutoff", ["record_id"]).select("team_id", "source", "record_id")


@query("d7_opening_and_latest", f"""{OBS} SELECT team_id, source, arg_min(record_id, (available_at, record_id)) AS opening_id, arg_max(record_id, (available_at, record_id)) AS latest_id, count(*) AS n
   FROM observations WHERE leakage_risk = 'safe' GROUP BY team_id, source""")
def d7(t: Tables):
    safe = t.observations.filter(A.is_safe())
    out = A.first_and_last(safe, ["team_id", "source"], ["available_at", "record_id"], ["record_id"], [F.count("*").alias("n")])
    return out.select("team_id", "source", F.col("opening.record_id").alias("opening_id"), F.col("latest.record_id").alias("latest_id"), "n")


@query("d8_strictly_earlier_date", f"""{READERS}, best AS (SELECT r.reader_id, arg_max(s.record_id, (CAST(s.available_at AS DATE), s.record_id)) AS record_id FROM reader r JOIN shown s
     ON r.team_id = s.team_id AND CAST(s.available_at AS DATE) < CAST(r.prediction_time AS DATE) GROUP BY r.reader_id)
   SELECT r.reader_id, b.record_id FROM reader r LEFT JOIN best b ON r.reader_id = b.reader_id""")
def d8(t: Tables):
    left = readers(t).withColumn("day", F.to_date("prediction_time").cast("timestamp"))
    right = shown(t).withColumn("day", F.to_date("available_at").cast("timestamp"))
    return A.asof_latest(left, right, ["team_id"], "day", "day", ["record_id"], ["record_id"], strict=True).select(
        "reader_id", F.col("obs.record_id").alias("record_id"))


@query("d9_previous_publication", f"""{OBS}, l AS (SELECT record_id, source, lag(record_id) OVER w AS prev_id, lag(source) OVER w AS prev_source FROM observations WHERE leakage_risk = 'safe'
   WINDOW w AS (PARTITION BY team_id ORDER BY available_at, record_id)) SELECT record_id, CASE WHEN prev_source = source THEN prev_id END AS prev_id FROM l""")
def d9(t: Tables):
    return A.previous_publication(t.observations, ["team_id"], ["record_id"], ["record_id"]).select("record_id", F.col("prev.record_id").alias("prev_id"))


@query("d10_duplicate_publication", f"""{OBS} SELECT team_id, {SECONDS.format("date_trunc('day', available_at)")} AS at, count(*) AS copies FROM observations GROUP BY 1, 2 HAVING count(*) > 1""")
def d10(t: Tables):
    daily = t.observations.withColumn("available_at", F.date_trunc("day", "available_at"))
    return A.duplicate_publications(daily, ["team_id"]).select("team_id", epoch("available_at").alias("at"), "copies")


# Releases are signup events: two periods that meet on a day set by the event's rank.
def releases(t: Tables):
    split = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("rank") % 30).cast("int"))
    start = F.lit("2024-01-01").cast("date")
    periods = F.array(F.struct(F.lit("UEFA").alias("value"), start.alias("valid_from"), split.alias("valid_to")),
                      F.struct(F.lit("AFC").alias("value"), split.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))
    return t.observations.filter("source = 'signup'").select("team_id", F.col("record_id").alias("release_id"), "available_at", periods.alias("periods"))


MEMBER_SQL = """rel AS (SELECT record_id AS release_id, team_id, available_at, DATE '2024-01-01' + CAST(rank % 30 AS INTEGER) AS split FROM observations WHERE source = 'signup')"""


@query("d11_interval_as_of", f"""{READERS}, {MEMBER_SQL}, best AS (SELECT r.reader_id, arg_max(s.release_id, (s.available_at, s.release_id)) AS release_id FROM reader r JOIN rel s
     ON r.team_id = s.team_id AND s.available_at <= r.prediction_time GROUP BY r.reader_id)
   SELECT r.reader_id, b.release_id, CASE WHEN b.release_id IS NULL THEN NULL WHEN CAST(r.prediction_time AS DATE) < rel.split THEN 'UEFA' ELSE 'AFC' END AS member
   FROM reader r LEFT JOIN best b ON r.reader_id = b.reader_id LEFT JOIN rel ON rel.release_id = b.release_id""")
def d11(t: Tables):
    facts = readers(t).withColumn("day", F.to_date("prediction_time"))
    return A.interval_as_of(facts, releases(t), ["team_id"], "day", "prediction_time").select(
        "reader_id", F.col("member_release").alias("release_id"), "member")


@query("d12_interval_overlap", """WITH p AS (SELECT l_orderkey AS k, l_partkey, CAST(l_shipdate AS DATE) AS f, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) - 3 END AS u FROM lineitem),
   x AS (SELECT *, lead(f) OVER (PARTITION BY k ORDER BY f, u NULLS LAST) AS nf FROM p)
   SELECT k, count(*) AS rows, count(*) FILTER (WHERE u <= f) AS empty_periods, count(*) FILTER (WHERE nf IS NOT NULL AND (u IS NULL OR nf < u)) AS overlaps FROM x
   WHERE u <= f OR (nf IS NOT NULL AND (u IS NULL OR nf < u)) GROUP BY k""")
def d12(t: Tables):
    start = F.col("l_shipdate").cast("date")
    end = F.when(F.col("l_linenumber") != 7, F.date_add(start, F.col("l_quantity").cast("int") - 3))
    p = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), start.alias("valid_from"), end.alias("valid_to"))
    bad = A.period_violations(p, ["k"])
    return bad.groupBy("k").agg(F.count("*").alias("rows"), F.count_if(F.array_contains("violations", "empty_period")).alias("empty_periods"),
                                F.count_if(F.array_contains("violations", "overlaps_next")).alias("overlaps"))


AS_OF = "1999-03-01"
CURRENT = REC + f""", vis AS (SELECT * FROM records WHERE available_at <= TIMESTAMP '{AS_OF}' AND recorded_at <= TIMESTAMP '{AS_OF}'),
   cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, entity_id ORDER BY recorded_at DESC, sequence DESC) AS rn FROM vis) WHERE rn = 1)"""


@query("d13_bitemporal_latest", CURRENT + " SELECT kind, entity_id, sequence, payload FROM cur")
def d13(t: Tables):
    return B.latest_as_of(t.records, AS_OF).select("kind", "entity_id", "sequence", "payload")


@query("d14_revision_history", CURRENT + " SELECT sequence, payload FROM vis WHERE kind = 'match' AND entity_id = 17 AND sequence > 1000000 AND sequence <= 140000000000 ORDER BY sequence LIMIT 25")
def d14(t: Tables):
    return B.history_page(t.records, "match", 17, AS_OF, 1000000, 140000000000, 25).select("sequence", "payload")


RID = "'record_' || sha256(kind || '|' || entity_id || '|' || epoch_us(available_at) || '|' || epoch_us(recorded_at) || '|' || payload)"


def addressed(t: Tables):
    return t.records.withColumn("record_id", B.record_id())


# Each forecast record names the latest 'match' record of its entity; kinds are mixed up on every tenth line.
@query("d15_lineage_resolution", CURRENT + f""", refs AS (SELECT sequence AS ref_from, CASE WHEN sequence % 10 = 0 THEN 'odds' ELSE kind END AS expected_kind, CASE WHEN sequence % 7 = 0 THEN entity_id + 1 ELSE entity_id END AS expected_entity,
     {RID} AS record_id FROM records WHERE kind = 'forecast')
   SELECT ref_from, CASE WHEN v.record_id IS NULL THEN 'unavailable' WHEN v.kind <> expected_kind THEN 'kind_mismatch' WHEN v.entity_id <> expected_entity THEN 'entity_mismatch' ELSE 'resolved' END AS status
   FROM refs r LEFT JOIN (SELECT DISTINCT {RID} AS record_id, kind, entity_id FROM vis) v ON v.record_id = r.record_id""")
def d15(t: Tables):
    rec = addressed(t)
    refs = rec.filter("kind = 'forecast'").select(
        F.col("sequence").alias("ref_from"), "record_id", F.when(F.col("sequence") % 10 == 0, F.lit("odds")).otherwise(F.col("kind")).alias("expected_kind"),
        F.when(F.col("sequence") % 7 == 0, F.col("entity_id") + 1).otherwise(F.col("entity_id")).alias("expected_entity"))
    return B.resolve_references(refs, rec, AS_OF).select("ref_from", "status")


@query("d16_idempotent_append", f"{REC}, a AS (SELECT DISTINCT {RID} AS record_id, kind FROM records), stored AS (SELECT DISTINCT {RID} AS record_id FROM records WHERE line <= 3) SELECT kind, count(*) AS appended FROM a WHERE record_id NOT IN (SELECT record_id FROM stored) GROUP BY kind")
def d16(t: Tables):
    rec = addressed(t)
    fresh = B.new_records(rec, rec.filter("line <= 3"))
    return fresh.groupBy("kind").agg(F.count("*").alias("appended"))


@query("d17_integrity_audit", f"{REC} SELECT sequence, 'record_' || sha256(kind || '|' || entity_id || '|' || epoch_us(available_at) || '|' || epoch_us(recorded_at) || '|' || CASE WHEN sequence % 19 = 0 THEN 'tampered' ELSE payload END) AS expected_id FROM records WHERE sequence % 19 = 0")
def d17(t: Tables):
    tampered = addressed(t).withColumn("payload", F.when(F.col("sequence") % 19 == 0, F.lit("tampered")).otherwise(F.col("payload")))
    return B.integrity_mismatches(tampered).select("sequence", "expected_id")


# A deliberately wrong feature: the team's previous match by date, whether or not its result was available.
@query("d18_leakage_audit", f"""{SIDES}, f AS (SELECT match_id, side, team_id, prediction_time, lag(match_id) OVER (PARTITION BY team_id ORDER BY match_date, match_id) AS ref FROM sides)
   SELECT f.match_id, f.side, f.ref AS reference FROM f JOIN eligible e ON e.match_id = f.ref WHERE e.eligible_at IS NULL OR e.eligible_at > f.prediction_time""")
def d18(t: Tables):
    from ..operators.skew import rolling

    sides = H.team_rows(t.eligible, ["prediction_time"])
    prev = rolling(sides, ["team_id"], ["match_date", "match_id"], 1, micros(F.col("match_date").cast("timestamp")),
                   {"ref": (F.last("match_id"), -1, -1)})
    feats = prev.withColumn("lineage", F.array_compact(F.array("ref")))
    return A.lineage_leaks(feats, t.eligible).select("match_id", "side", "reference")


@query("d19_published_by", f"{OBS} SELECT record_id FROM observations WHERE available_at <= TIMESTAMP '2024-01-12 06:00:00'")
def d19(t: Tables):
    return A.published_by(t.observations, "2024-01-12T06:00:00Z").select("record_id")


@query("d20_upcoming_fixtures", f"""{ctes("matches")} SELECT match_id FROM matches WHERE match_date >= DATE '1998-06-01' AND match_date <= DATE '1999-12-31' AND (kickoff_at IS NULL OR kickoff_at > TIMESTAMP '1998-06-01 10:00:00')
   AND status = 'scheduled' AND home_id % 10 <> 3""")
def d20(t: Tables):
    named = t.matches.withColumn("home_team", F.when(F.col("home_id") % 10 == 3, F.lit("Winner TBD")).otherwise(F.lit("x"))).withColumn("away_team", F.lit("y"))
    return A.upcoming_fixtures(named, "1998-06-01T10:00:00Z", None, "1999-12-31").select("match_id")


@query("d21_latest_ledger_per_fixture", f"""{ctes("predictions")} SELECT match_id, max(row_id * 1000000 + CAST(floor(p_home * 100000) AS BIGINT)) AS pick FROM predictions
   WHERE (match_id, prediction_time) IN (SELECT (match_id, max(prediction_time)) FROM predictions GROUP BY match_id) GROUP BY match_id""")
def d21(t: Tables):
    led = t.predictions.withColumn("pick", F.col("row_id") * 1000000 + F.floor(F.col("p_home") * 100000))
    return A.latest_per(led, ["match_id"], ["prediction_time", "pick"]).select("match_id", "pick")


@query("d22_cutoff_validity", f"""{ctes("matches")}, c AS (SELECT *, CAST(match_date AS TIMESTAMP) + to_hours(CAST(home_score * 5 - 6 AS BIGINT)) AS prediction_time FROM matches)
   SELECT match_id, CASE WHEN kickoff_at IS NULL THEN 'not_before_match_date' ELSE 'after_kickoff' END AS violation FROM c
   WHERE prediction_time > kickoff_at OR (kickoff_at IS NULL AND CAST(prediction_time AS DATE) >= match_date)""")
def d22(t: Tables):
    c = t.matches.withColumn("prediction_time", F.expr("timestampadd(HOUR, CAST(home_score * 5 - 6 AS INT), CAST(match_date AS TIMESTAMP))"))
    return A.cutoff_violations(c).select("match_id", F.concat_ws(",", "violations").alias("violation"))
