"""Judge urls by host rules, and hosts without a rule by trust and distrust carried over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_side, written

# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FOLLOW = 0.5      # share of a host's trust that its links pass on
ROUNDS = 12       # what is left to pass on after them is below FOLLOW ** ROUNDS
BLOCK_FROM = 0.5  # distrust less trust above this blocks, in units of what a host gets whose every link goes to a wholly blocked host
DIGITS = 9        # masses are compared after rounding, as their sums depend on the order
HOST_ROWS = 200_000  # hosts up to which their scores are broadcast
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end; path: from there up to ? # or the end; else both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.coalesce(F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.substr(rest, F.length(F.substring_index(rest, "/", 1)) + 1), F.lit(""))
    return host, path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer rules are tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between hosts, and both ways between a host and the domain above it; the shares of a src sum to 1.

    pages: host, html. Links count once per page and target; the tie to the domain above counts as one link.
    """
    linked = (pages.filter(F.col("host") != "")
              .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))).alias("to"))
              .select("src", F.translate("to", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("w")))
    names = pages.filter(F.col("host") != "").select("host").distinct()
    above = names.filter(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("src"), F.expr("substr(host, instr(host, '.') + 1)").alias("dst"), F.lit(1).cast("long").alias("w"))
    edges = linked.unionByName(above).unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).filter("src <> dst")
    edges = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return edges.join(edges.groupBy("src").agg(F.sum("w").alias("all_w")), "src").select("src", "dst", (F.col("w") / F.col("all_w")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): personalised PageRank in units of seed mass: seed plus follow times what reaches the host along edges.

    seeds: kind, host, mass; edges: kind, src, dst, share. Kinds do not mix; they share the rounds. Each round joins the wave on
    its source and sums by target, so a host with very many links is combined before the shuffle; the wave goes through
    the checkpoint folder. Up to HOST_ROWS edges are broadcast, so that a round shuffles sums only.
    """
    edges = small_side(edges.withColumnRenamed("src", "host"), HOST_ROWS)
    wave = total = seeds
    for _ in range(rounds):
        step = wave.join(edges, ["kind", "host"]).groupBy("kind", "dst").agg(F.sum(F.col("mass") * F.col("share") * follow).alias("mass"))
        wave = written(step.withColumnRenamed("dst", "host"))
        if wave.isEmpty():
            break
        total = total.unionByName(wave)
    return total.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge(pages: DataFrame, rules=RULES, block_from: float = BLOCK_FROM) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust; the rule's verdict, else block where distrust less trust is above block_from.

    Trusted seeds are hosts by the share of their pages that rules allow, blocked seeds by the share that they block.
    Trust follows links from the trusted; distrust runs against the links, from the blocked to those that link to them.

    Null url or one without ``://``: empty host and path, no rule, allow. Null html: no links. Repeated rows are judged
    each. No rows: no rows. Other columns pass through, except those named like an added one.
    """
    added = ["host", "path", "rule", "verdict", "trust", "distrust"]
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*[c for c in pages.columns if c not in added], host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    edges = written(host_edges(rows.select("host", "html")))
    by_host = written(rows.filter(F.col("host") != "").groupBy("host").agg(
        F.avg((F.coalesce(F.col("verdict"), F.lit("")) == "allow").cast("double")).alias("good"), F.avg((F.coalesce(F.col("verdict"), F.lit("")) == "block").cast("double")).alias("bad")))
    seeds = by_host.select("host", F.explode(F.create_map(F.lit("trust"), F.col("good"), F.lit("distrust"), F.col("bad"))).alias("kind", "mass")).filter("mass > 0")
    both = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share", F.lit("distrust").alias("kind")))
    mass = propagate(seeds, written(both))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("mass"))).alias(k) for k in ("trust", "distrust")]
    scores = mass.groupBy("host").agg(*sums).na.fill(0.0, ["trust", "distrust"])
    judged = rows.join(small_side(written(scores), HOST_ROWS), "host", "left").na.fill(0.0, ["trust", "distrust"])
    by_method = F.when(F.round((F.col("distrust") - F.col("trust")) / FOLLOW, DIGITS) > block_from, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce("verdict", by_method))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(read_table(spark, folder, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
