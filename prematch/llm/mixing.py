"""Mix sources to target weights by systematic sampling (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, read_table

CYCLE = (3, 1, 2)      # weights of the sources in code point order, repeating
SHARE = 1.5            # the mix takes this multiple of all words
MAX_COPIES = 2.0       # no source, and so no document, is taken more often
SEED = "mix"
CELL_DIGITS = 3        # hex digits of the order key that split one (source, size) into cells


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """Words to take from each source; one row per source comes in (source, source_size) and goes out with target.

    Weighted shares that exceed ``most`` times a source stop there and the excess is shared again by weight. That
    is the level L at which the sum of least(L * weight, most * size) is the wanted total: sources stop in the
    order of size / weight, so running sums over that order give L directly. A table with one row per source.
    """
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(most) * F.col("source_size"))
    filling = W.partitionBy().orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    ranked = (ranked
              .withColumn("rest", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
              .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.col("rest") / F.col("rest_weight")
    # the first source in filling order that does not stop sets the level for all
    ranked = ranked.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), level.alias("at")))).over(everything)["at"])
    return ranked.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random start of a source in [0, 1), the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, cycle=CYCLE, share: float = SHARE, most: float = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The rows of docs with size, source_size, target and copies (0 to ``most``, rounded up).

    Within a source every document expects rate = target / source_size copies. In the order of (size, a hash of doc_id),
    the k-th document gets floor(offset + k * rate) - floor(offset + (k - 1) * rate) copies: one per integer
    crossed by the prefix sum. Because the order is by size, the words taken differ from the target by less than the
    largest document of the source.

    The rank k is the number of rows in earlier cells plus the rank in the own cell. A cell is (source, size, first digits
    of the hash), so a source with most of the rows, and a size shared by thousands of copies, are spread over
    many tasks; the tables of cells and of (source, size) hold one row per cell and per distinct size.

    Null text: size 0. Null source: a source of its own, the last. Null doc_id: hashed as the empty string. Rows that agree
    in doc_id and text are interchangeable. No rows: no rows. Other columns pass through; those named like an added
    column, or starting with ``mix_``, are replaced.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    added = ["size", "source_size", "target", "copies"]
    base = docs.drop(*added).withColumns({"size": size, "mix_hash": hashed, "mix_cell": F.substring(hashed, 1, CELL_DIGITS), "mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    cells = base.groupBy("mix_source", "source", "size", "mix_cell").agg(F.count("*").alias("mix_n"))
    in_size = W.partitionBy("mix_source", "size").orderBy("mix_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("mix_before", F.coalesce(F.sum("mix_n").over(in_size), F.lit(0)))
    by_size = cells.groupBy("mix_source", "source", "size").agg(F.sum("mix_n").alias("mix_n"))
    in_source = W.partitionBy("mix_source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = by_size.withColumn("mix_smaller", F.coalesce(F.sum("mix_n").over(in_source), F.lit(0)))
    totals = by_size.groupBy("source").agg(F.sum(F.col("mix_n") * F.col("size")).alias("source_size"))
    targets = source_targets(totals, cycle, share, most).withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    start = (cells.select("mix_source", "size", "mix_cell", "mix_before")
             .join(sizes.select("mix_source", "size", "mix_smaller"), ["mix_source", "size"])
             .join(targets, "mix_source")
             .select("mix_source", "size", "mix_cell", "source_size", "target", (F.col("mix_before") + F.col("mix_smaller")).alias("mix_start")))
    in_cell = W.partitionBy("mix_source", "size", "mix_cell").orderBy("mix_hash", "doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    k = F.col("mix_start") + F.col("mix_rank")
    return (base.withColumn("mix_rank", F.row_number().over(in_cell))
            .join(start, ["mix_source", "size", "mix_cell"])
            .withColumn("copies", (F.floor(u + k * rate) - F.floor(u + (k - 1) * rate)).cast("long"))
            .select(*[c for c in docs.columns if c not in added], *added))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document once per copy, with copy counting from 1; documents with no copies are left out."""
    mixed = mix(docs, **settings)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns, "copy")


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(read_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS most FROM s),
r AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s)
            - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
         (SELECT sum(weight)::BIGINT FROM w)
            - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_weight
  FROM w),
lv AS (SELECT rest / rest_weight AS level FROM r WHERE rest / rest_weight * weight <= most ORDER BY most / weight, rest / rest_weight LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM lv) * weight, most), most) AS target,
             ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r),
k AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.h, d.doc_id, md5(coalesce(d.text, ''))) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(u + k * rate) - floor(u + (k - 1) * rate))::BIGINT AS taken FROM k
"""
