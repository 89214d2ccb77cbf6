"""Rule tables over whole frames and catalog audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_names


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows breaking it, from a single pass."""
    one = df.agg(F.count("*").alias("__total"), *[F.count_if(c).alias(name) for name, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations"), F.col("__total").alias("rows")) for n in rules])
    return one.select(F.inline(rows))


def require_clean(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Raise when any rule is broken, else hand the frame on. The message lists the counts."""
    broken = {r["rule"]: r["violations"] for r in rule_counts(df, rules).collect() if r["violations"]}
    if broken:
        raise ValueError(f"Rows break declared rules: {broken}")
    return df


def catalog_violations(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Problems of a catalog: (code, subject). entities (entity_id, name); aliases (label, entity_id)."""
    named = normalize_names(entities, "name", "key").select("entity_id", "key")
    labels = normalize_names(aliases, "label", "key").select("entity_id", "key")

    def issue(df: DataFrame, code: str, subject: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    def repeated(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")

    owner = named.groupBy("key").agg(F.min("entity_id").alias("owner"))
    # count_distinct needs one value per alias key only: compare the extremes instead of gathering sets
    spread = labels.filter("key <> ''").groupBy("key").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    parts = [
        issue(repeated(entities, "entity_id"), "duplicate_id", F.col("entity_id")),
        issue(repeated(named, "key"), "duplicate_name", F.col("key")),
        issue(labels.filter("key = ''"), "blank_alias", F.col("entity_id")),
        issue(labels.join(entities.select("entity_id"), "entity_id", "left_anti"), "unknown_alias_target", F.col("key")),
        issue(spread.join(owner, "key").filter("lo <> owner OR hi <> owner"), "alias_conflicts_with_name", F.col("key")),
        issue(spread.filter("lo <> hi"), "ambiguous_alias", F.col("key")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def quality_report(routed: DataFrame) -> DataFrame:
    """Counts by decision and whether the batch is valid: not empty and nothing set aside."""
    n = {d: F.count_if(F.col("decision") == d) for d in ("normalized", "excluded", "quarantined")}
    return routed.agg(F.count("*").alias("total"), *[v.alias(k) for k, v in n.items()]).withColumn(
        "valid", (F.col("total") > 0) & (F.col("excluded") == 0) & (F.col("quarantined") == 0))


def quality_issues(routed: DataFrame) -> DataFrame:
    """Issue counts by decision and reason kind (the part of a reason before its subject)."""
    return (
        routed.filter("decision <> 'normalized'")
        .select("decision", F.explode("reasons").alias("reason"))
        .groupBy("decision", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
    )
