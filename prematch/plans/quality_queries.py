"""Entity resolution and data quality (C*) over the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import entities as E
from ..operators import quality as Q
from .bindings import Tables, ctes
from .registry import query
from .scalar_queries import DAY, SCOPE_SQL

# The results say "Team n": for n up to 49 that is a canonical name, for 50..79 an alias of team n - 50, for others unknown ("Club n", "Alias n").
CANON_SQL = "SELECT CASE WHEN c_custkey < 50 THEN 'team ' ELSE 'club ' END || c_custkey AS k, c_custkey AS id FROM customer"
ALIAS_SQL = "SELECT CASE WHEN c_custkey BETWEEN 50 AND 79 THEN 'team ' ELSE 'alias ' END || c_custkey AS k, CASE WHEN c_custkey BETWEEN 50 AND 79 THEN c_custkey - 50 ELSE c_custkey END AS id FROM customer"
NORM = "lower(regexp_replace(trim({0}), '\\s+', ' ', 'g'))"
RESOLVED = f"""{ctes("raw_results")}, canon AS ({CANON_SQL}), alias AS ({ALIAS_SQL}), res AS (SELECT r.*, {DAY} AS match_date,
   coalesce(hc.id, ha.id) AS home_id, CASE WHEN hc.id IS NOT NULL THEN 'canonical_name' WHEN ha.id IS NOT NULL THEN 'alias' END AS home_by,
   coalesce(ac.id, aa.id) AS away_id, CASE WHEN ac.id IS NOT NULL THEN 'canonical_name' WHEN aa.id IS NOT NULL THEN 'alias' END AS away_by,
   CASE WHEN tournament <> 'Regional Cup' THEN tournament END AS competition_id, tournament <> 'Friendly' AS in_scope
   FROM raw_results r LEFT JOIN canon hc ON {NORM.format('r.home_team')} = hc.k LEFT JOIN alias ha ON {NORM.format('r.home_team')} = ha.k
   LEFT JOIN canon ac ON {NORM.format('r.away_team')} = ac.k LEFT JOIN alias aa ON {NORM.format('r.away_team')} = aa.k)"""
ROUTED = RESOLVED + f""", scoped AS (SELECT *, {SCOPE_SQL} AS scope, concat_ws('|',
     CASE WHEN home_id IS NULL THEN 'unresolved_home_team:' || trim(home_team) END,
     CASE WHEN away_id IS NULL THEN 'unresolved_away_team:' || trim(away_team) END,
     CASE WHEN competition_id IS NULL THEN 'unresolved_competition:' || tournament END) AS unresolved FROM res),
   routed AS (SELECT *, CASE WHEN scope LIKE 'exclude:%' THEN 'excluded' WHEN scope LIKE 'review:%' THEN 'quarantined'
     WHEN unresolved <> '' THEN 'quarantined' WHEN NOT in_scope THEN 'excluded' ELSE 'normalized' END AS decision,
     CASE WHEN scope NOT LIKE 'include:%' THEN substr(scope, strpos(scope, ':') + 1) WHEN unresolved <> '' THEN unresolved
     WHEN NOT in_scope THEN 'competition_out_of_scope' ELSE 'canonicalized' END AS reasons FROM scoped)"""
# A row without a date has no group and is nobody's copy.
DEDUPED = ROUTED + """, ranked AS (SELECT *, row_number() OVER w AS rn, first_value(row_no) OVER w AS first_no FROM routed
     WINDOW w AS (PARTITION BY decision, match_date, least(home_id, away_id), greatest(home_id, away_id), competition_id ORDER BY row_no)),
   final AS (SELECT row_no, match_date, home_id, away_id, competition_id,
     CASE WHEN later THEN 'quarantined' ELSE decision END AS decision,
     CASE WHEN later THEN 'duplicate_or_reversed_fixture:' || first_no ELSE reasons END AS reasons
     FROM (SELECT *, decision = 'normalized' AND match_date IS NOT NULL AND rn > 1 AS later FROM ranked))"""


def catalogs(t: Tables):
    c = t.raw("customer")
    # the whole catalog: every customer has a name and an alias, and which of the two the results use depends on the id
    key, other = F.col("c_custkey"), F.col("c_custkey").between(50, 79)
    canonical = c.select(F.concat(F.when(key < 50, F.lit("Team ")).otherwise(F.lit("Club ")), key).alias("name"), key.alias("entity_id"))
    aliases = c.select(F.concat(F.when(other, F.lit("Team ")).otherwise(F.lit("Alias ")), key).alias("label"), F.when(other, key - 50).otherwise(key).alias("entity_id"))
    return canonical, aliases


def resolved(t: Tables):
    canonical, aliases = catalogs(t)
    df = t.view("raw_results").withColumn("match_date", F.try_to_date(F.trim("date"), "yyyy-MM-dd"))
    df = E.resolve(E.resolve(df, "home_team", canonical, aliases, "home_id"), "away_team", canonical, aliases, "away_id")
    return df.withColumn("competition_id", F.when(F.col("tournament") != "Regional Cup", F.col("tournament")))


def routed(t: Tables):
    return E.route(resolved(t), F.col("tournament") != "Friendly")


def final(t: Tables):
    return E.quarantine_duplicates(routed(t), "row_no", "row_no")


@query("c1_entity_resolution", RESOLVED + " SELECT row_no, home_id, home_by, away_id, away_by FROM res")
def c1(t: Tables):
    return resolved(t).select("row_no", "home_id", F.col("home_id_matched_by").alias("home_by"), "away_id", F.col("away_id_matched_by").alias("away_by"))


# Catalog with planted faults: ids repeat modulo 1400, names modulo 1300, aliases overlap names and each other.
@query("c2_catalog_integrity", """WITH e AS (SELECT c_custkey % 1400 AS entity_id, 'name ' || c_custkey % 1300 AS k FROM customer),
   a AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'name ' || c_custkey ELSE 'alias ' || c_custkey % 1200 END AS k, c_custkey + 1 AS entity_id FROM customer),
   owner AS (SELECT k, min(entity_id) AS owner FROM e GROUP BY k)
   SELECT 'duplicate_id' AS code, CAST(entity_id AS VARCHAR) AS subject FROM e GROUP BY entity_id HAVING count(*) > 1
   UNION ALL SELECT 'duplicate_name', k FROM e GROUP BY k HAVING count(*) > 1
   UNION ALL SELECT 'blank_alias', CAST(entity_id AS VARCHAR) FROM a WHERE k = ''
   UNION ALL SELECT 'unknown_alias_target', k FROM a WHERE entity_id NOT IN (SELECT entity_id FROM e)
   UNION ALL SELECT 'alias_conflicts_with_name', a.k FROM a JOIN owner ON a.k = owner.k WHERE a.k <> '' GROUP BY a.k, owner HAVING count(*) FILTER (WHERE entity_id <> owner) > 0
   UNION ALL SELECT 'ambiguous_alias', k FROM a WHERE k <> '' GROUP BY k HAVING count(DISTINCT entity_id) > 1""")
def c2(t: Tables):
    c = t.raw("customer")
    entities = c.select((F.col("c_custkey") % 1400).alias("entity_id"), F.concat(F.lit("Name  "), F.col("c_custkey") % 1300).alias("name"))
    label = F.when(F.col("c_custkey") % 50 == 0, F.lit(" ")).when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("NAME "), F.col("c_custkey"))).otherwise(
        F.concat(F.lit("Alias "), F.col("c_custkey") % 1200))
    return Q.catalog_violations(entities, c.select(label.alias("label"), (F.col("c_custkey") + 1).alias("entity_id")))


@query("c3_disposition_routing", ROUTED + " SELECT row_no, decision, reasons, CASE WHEN decision = 'normalized' THEN substr(sha256(concat_ws('|', CAST(match_date AS VARCHAR), CAST(home_id AS VARCHAR), CAST(away_id AS VARCHAR), competition_id)), 1, 20) END AS match_id FROM routed")
def c3(t: Tables):
    return routed(t).select("row_no", "decision", F.concat_ws("|", "reasons").alias("reasons"), "match_id")


@query("c4_duplicate_quarantine", DEDUPED + " SELECT row_no, decision, reasons FROM final")
def c4(t: Tables):
    return final(t).select("row_no", "decision", F.concat_ws("|", "reasons").alias("reasons"))


@query("c5_split_outputs", DEDUPED + """ SELECT 'normalized' AS output, row_no, CAST(home_id AS VARCHAR) || '-' || away_id AS detail FROM final WHERE decision = 'normalized'
   UNION ALL SELECT decision, row_no, reasons FROM final WHERE decision <> 'normalized'""")
def c5(t: Tables):
    parts = E.split_dispositions(final(t))
    rows = parts["normalized"].select(F.lit("normalized").alias("output"), "row_no", F.concat_ws("-", "home_id", "away_id").alias("detail"))
    for name in ("excluded", "quarantined"):
        rows = rows.unionByName(parts[name].select(F.lit(name).alias("output"), "row_no", F.col("reasons").alias("detail")))
    return rows


@query("c6_quality_report", DEDUPED + """ SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'normalized') AS normalized,
   count(*) FILTER (WHERE decision = 'excluded') AS excluded, count(*) FILTER (WHERE decision = 'quarantined') AS quarantined,
   count(*) > 0 AND count(*) FILTER (WHERE decision <> 'normalized') = 0 AS valid FROM final""")
def c6(t: Tables):
    return Q.quality_report(final(t))


@query("c6_quality_issues", DEDUPED + """ SELECT decision, split_part(r, ':', 1) AS reason, count(*) AS n FROM (SELECT decision, unnest(string_split(reasons, '|')) AS r FROM final WHERE decision <> 'normalized') GROUP BY 1, 2""")
def c6_issues(t: Tables):
    return Q.quality_issues(final(t))


# Stored side: the same matches with home and away swapped on every third row.
@query("c7_reversed_against_stored", f"""{ctes("matches")}, stored AS (SELECT CASE WHEN match_id % 3 = 0 THEN match_id + 1000000 ELSE match_id END AS match_id, match_date,
     least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, competition_id FROM matches)
   SELECT m.match_id, CASE WHEN max(s.match_id) <> m.match_id THEN max(s.match_id) ELSE min(s.match_id) END AS stored_match_id
   FROM matches m JOIN stored s ON m.match_date = s.match_date AND least(m.home_id, m.away_id) = s.lo AND greatest(m.home_id, m.away_id) = s.hi AND m.competition_id = s.competition_id
   GROUP BY m.match_id HAVING max(s.match_id) <> m.match_id OR min(s.match_id) <> m.match_id""")
def c7(t: Tables):
    m = t.matches
    swap = F.col("match_id") % 3 == 0
    stored = m.select(F.when(swap, F.col("match_id") + 1000000).otherwise(F.col("match_id")).alias("match_id"), "match_date",
                      F.when(swap, F.col("away_id")).otherwise(F.col("home_id")).alias("home_id"),
                      F.when(swap, F.col("home_id")).otherwise(F.col("away_id")).alias("away_id"), "competition_id")
    return E.reversed_against_stored(m, stored).select("match_id", "stored_match_id")


@query("c8_alias_rating_lookup", f"""{ctes("matches")}, r AS (SELECT 'T' || s_suppkey AS team, 1000 + s_acctbal / 10 AS rating FROM supplier WHERE s_suppkey < 40),
   l AS (SELECT match_id, 'T' || home_id AS home, 'T' || away_id AS away, CASE WHEN home_id BETWEEN 40 AND 59 THEN 'T' || (home_id - 40) ELSE 'T' || home_id END AS hl,
     CASE WHEN away_id BETWEEN 40 AND 59 THEN 'T' || (away_id - 40) ELSE 'T' || away_id END AS al FROM matches)
   SELECT match_id, CASE WHEN h.rating IS NULL THEN 'fallback_1500' WHEN hl <> home THEN 'alias_lookup' ELSE 'rating_lookup' END AS home_rating_source,
     round(coalesce(h.rating, 1500e0), 6) + 0.0 AS home_rating, round(coalesce(a.rating, 1500e0), 6) + 0.0 AS away_rating,
     CASE WHEN h.rating IS NULL AND a.rating IS NULL THEN 'fallback_rating_used:' || home || ',' || away WHEN h.rating IS NULL THEN 'fallback_rating_used:' || home
       WHEN a.rating IS NULL THEN 'fallback_rating_used:' || away ELSE '' END AS rating_warning
   FROM l LEFT JOIN r h ON hl = h.team LEFT JOIN r a ON al = a.team""")
def c8(t: Tables):
    s = t.raw("supplier")
    name = F.concat(F.lit("T"), F.col("s_suppkey"))
    ratings = s.filter("s_suppkey < 40").select(name.alias("team"), (1000 + F.col("s_acctbal") / 10).alias("rating"))
    aliases = s.filter("s_suppkey BETWEEN 40 AND 59").select(name.alias("label"), F.concat(F.lit("T"), F.col("s_suppkey") - 40).alias("team"))
    fixtures = t.matches.select("match_id", F.concat(F.lit("T"), F.col("home_id")).alias("home_team"), F.concat(F.lit("T"), F.col("away_id")).alias("away_team"))
    from ..functions.common import r6

    return E.lookup_ratings(fixtures, ratings, aliases).select(
        "match_id", "home_rating_source", r6("home_rating").alias("home_rating"), r6("away_rating").alias("away_rating"), "rating_warning")


# eight sums of the 32-bit words of the row hash h
CONTENT_SUM = "concat_ws('-', " + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * k + 1}, 8)) AS BIGINT)) AS VARCHAR)" for k in range(8)) + ") AS content_sum"


@query("c9_table_fingerprint", f"""{ctes("matches")} SELECT competition_id, count(*) AS row_count,
   {CONTENT_SUM} FROM (SELECT competition_id, sha256(concat_ws(chr(31), CAST(match_id AS VARCHAR), CAST(match_date AS VARCHAR), CAST(home_score AS VARCHAR), CAST(neutral AS VARCHAR))) AS h FROM matches) GROUP BY competition_id""")
def c9(t: Tables):
    return ids.fingerprint(t.matches, ["match_id", "match_date", "home_score", "neutral"], ["competition_id"])


@query("c10_rule_audit", f"""{ctes("predictions")}, x AS (SELECT count(*) AS n, count(*) FILTER (WHERE home_id = away_id) AS self_play, count(*) FILTER (WHERE home_odds <= 1.2) AS low_odds,
   count(*) FILTER (WHERE abs(p_home + p_draw + p_away - 1) > 1e-9) AS probability_sum, count(*) FILTER (WHERE actual IS NULL) AS outcome_missing,
   count(*) FILTER (WHERE prediction_time < TIMESTAMP '1995-06-01 00:00:00') AS too_early FROM predictions)
   SELECT rule, CAST(CASE rule WHEN 'self_play' THEN self_play WHEN 'low_odds' THEN low_odds WHEN 'probability_sum' THEN probability_sum WHEN 'outcome_missing' THEN outcome_missing ELSE too_early END AS BIGINT) AS violations,
     n AS rows FROM x, (VALUES ('self_play'), ('low_odds'), ('probability_sum'), ('outcome_missing'), ('too_early')) AS v(rule)""")
def c10(t: Tables):
    from ..functions import probability as P

    return Q.rule_counts(t.predictions, {
        "self_play": F.col("home_id") == F.col("away_id"), "low_odds": F.col("home_odds") <= 1.2,
        "probability_sum": F.abs(sum(P.triple()[1:], P.triple()[0]) - 1) > 1e-9, "outcome_missing": F.col("actual").isNull(),
        "too_early": F.col("prediction_time") < F.lit("1995-06-01").cast("timestamp")})


# The three outputs of the normalisation, published as one release and read back from it.
@query("a12_export_roundtrip", DEDUPED + """, o AS (SELECT unnest(['normalized', 'excluded', 'quarantined']) AS output)
   SELECT o.output, count(final.row_no) AS rows, TRUE AS equal FROM o LEFT JOIN final ON final.decision = o.output GROUP BY o.output""")
def a12(t: Tables):
    from ..session import ensure_checkpoint_dir
    from ..sources import publish

    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext.getCheckpointDir()}/exports-{uuid.uuid4().hex}"
    parts = E.split_dispositions(final(t).checkpoint())
    release = publish.publish(parts, root, "normalization")
    schemas = {name: df.schema for name, df in parts.items()}
    back = publish.read_release(t.spark, root, schemas, release, verify=True)
    sides = [df.agg(F.count("*").alias("rows"), publish.fingerprint(df).alias("f")).select(F.lit(name).alias("output"), F.lit(side).alias("side"), "rows", "f")
             for side, tables in (("before", parts), ("after", back)) for name, df in tables.items()]
    both = reduce(lambda a, b: a.unionByName(b), sides)
    return both.groupBy("output").agg(F.max(F.when(F.col("side") == "after", F.col("rows"))).alias("rows"), (F.count_distinct("f") == 1).alias("equal"))
