"""Reject documents whose statistics lie far from their language and source (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, small_side, text_words, written

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
SPAN = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

UNIT = 1024             # statistics are whole multiples of 1/UNIT, so that sums do not depend on their order
FLOORS = (0.25, 0.08, 0.22, 0.1, 0.1)  # least standard deviation of each statistic; also keeps the estimate regular. Of symbols it leaves room for tables
KEEP_SHARE = 0.75       # the minimum-covariance-determinant subset
CONSISTENCY = 1.41      # covariance of the central 75 % of a 5-variate normal to that of all of it
CUTOFF = 20.515         # squared distance; 1 in a thousand of a 5-variate normal lies beyond
STEPS = 4
MIN_GROUP = 60          # smaller groups are estimated together with the other small ones of their language
GROUP_ROWS = 100_000    # groups up to which their estimates are broadcast
BINS = 64               # bins of the squared distance per e-fold


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, from the whole text and without a shuffle.

    Repeated 8-word windows are found in the row: window hashes are sorted with their starts, neighbours with equal
    hashes mark their starts, and the union of the marked windows is counted.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    rows = docs.drop(*names).withColumns({"q_words": text_words(F.col("text")), "q_lines": lines})
    starts = F.sequence(F.lit(1), F.size("q_words") - (SPAN - 1))
    rows = rows.withColumn("q_keys", F.when(F.size("q_words") >= SPAN, F.transform(starts, lambda p: F.xxhash64(F.slice("q_words", p, SPAN)))))
    pairs = F.sort_array(F.transform("q_keys", lambda key, i: F.struct(key.alias("key"), i.alias("i"))))
    rows = rows.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_keys")) < F.size("q_keys"), pairs))

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(F.col("q_sorted"), k - 1)["key"], F.get(F.col("q_sorted"), k + 1)["key"]
        return F.coalesce(x["key"] == before, F.lit(False)) | F.coalesce(x["key"] == after, F.lit(False))

    marks = F.array_sort(F.transform(F.filter("q_sorted", repeated), lambda x: x["i"]))
    union = F.aggregate(marks, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                        lambda s, i: F.struct((s["n"] + i + SPAN - F.greatest(i, s["reach"])).alias("n"), (i + SPAN).alias("reach")), lambda s: s["n"])
    return rows.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("q_lines").cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(union, F.lit(0)).cast("long"),
    }).drop("q_words", "q_lines", "q_keys", "q_sorted")


def statistic_vector() -> list[Column]:
    """The transformed statistics, in units of 1/UNIT."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [F.log1p(F.col("n_words").cast("double")), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n),
           F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def groups_of(rows: DataFrame) -> DataFrame:
    """(lang, source, grp): the group that each (lang, source) is estimated in; null where even the pool is too small."""
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= MIN_GROUP
    pool = F.sum(F.when(~own, F.col("n"))).over(W.partitionBy("lang"))
    key = F.when(own, F.to_json(F.struct("lang", "source"))).when(pool >= MIN_GROUP, F.concat(F.lit("rest of "), F.to_json(F.struct("lang"))))
    return counts.select("lang", "source", key.alias("grp"))


def start_estimate(rows: DataFrame) -> DataFrame:
    """Per group the median and the median absolute deviation of each statistic, as a first centre and diagonal scale.

    Order statistics come from counts per value (whole numbers of bounded range), never from gathered rows.
    """
    long = rows.select("grp", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(P)])).alias("f", "v"))

    def median(counts: DataFrame) -> DataFrame:
        by = W.partitionBy("grp", "f")
        run = F.sum("n").over(by.orderBy("v"))
        ranked = counts.withColumn("reached", 2 * run >= F.sum("n").over(by))
        return ranked.filter("reached").groupBy("grp", "f").agg(F.min("v").alias("m"))

    counts = long.groupBy("grp", "f", "v").agg(F.count("*").alias("n"))
    centre = median(counts)
    away = counts.join(centre, ["grp", "f"]).groupBy("grp", "f", F.abs(F.col("v") - F.col("m")).alias("v")).agg(F.sum("n").alias("n"))
    both = centre.join(median(away).withColumnRenamed("m", "mad"), ["grp", "f"])
    floor = F.element_at(F.array(*[F.lit(x * UNIT) for x in FLOORS]), F.col("f") + 1)
    scale = F.greatest(1.4826 * F.col("mad"), floor)
    wide = both.groupBy("grp").agg(*[F.max(F.when(F.col("f") == i, F.col("m"))).cast("double").alias(f"m{i}") for i in range(P)],
                                   *[F.max(F.when(F.col("f") == i, scale)).alias(f"l{i}{i}") for i in range(P)])
    return wide.withColumns({f"l{i}{j}": F.lit(0.0) for i, j in PAIRS if i != j})


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with d2, one triangular solve step per projection; null without an estimate."""
    out = rows.join(estimate, "grp", "left")
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(P):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return out.withColumn("d2", total).drop(*[c for c in out.columns if c[0] in "mly" and c[1:].isdigit()])


def concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One C-step: mean and covariance of the KEEP_SHARE nearest rows of each group, as a centre and a triangular factor.

    Rows are summed per (group, distance bin), so one map-side aggregate gives both the cut and the sums under it; the bin
    that crosses the share counts whole.
    """
    bins = F.floor(BINS * F.log1p("d2")).alias("bin")
    sums = [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]
    cells = with_distance(rows, estimate).select("grp", bins, *[f"x{i}" for i in range(P)]).groupBy("grp", "bin").agg(*sums)
    by = W.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = cells.withColumn("near", before < KEEP_SHARE * F.sum("n").over(by)).filter("near")
    total = near.groupBy("grp").agg(*[F.sum(c).cast("double").alias(c) for c in cells.columns if c not in ("grp", "bin")])
    out = total.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    floor = [(x * UNIT) ** 2 for x in FLOORS]
    for i, j in PAIRS:  # Cholesky, row by row
        v = CONSISTENCY * (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        if i == j:
            v = F.greatest(v, F.lit(0.0)) + floor[i]
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1.0))) if i == j else v / F.col(f"l{j}{j}"))
    return out.select("grp", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def judge(docs: DataFrame) -> DataFrame:
    """docs' columns but the text, with the base statistics, base_failed, d2 and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. The estimate of a group is taken
    over its documents that pass the base rules; kept is false if base_failed or if the squared Mahalanobis distance exceeds
    CUTOFF. Groups are (lang, source), null being a value; those under MIN_GROUP rows share one estimate per language,
    and a pool that is still smaller rejects nothing (d2 null).

    A null or empty text has no words and fails. Repeated rows are judged each. No rows: no rows. Other columns pass
    through, except those named like an added one.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", "grp", *[f"x{i}" for i in range(P)]]
    keep = [c for c in docs.columns if c not in added and c != "text"]
    # whatever else the user's rows hold travels in one struct, so no name of theirs meets a helper's
    extras = [c for c in keep if c not in ("lang", "source")]
    carried = ["lang", "source", *(["user_columns"] if extras else [])]
    packed = [F.struct(*[F.col(f"`{c}`") for c in extras]).alias("user_columns")] if extras else []
    stats = base_statistics(docs.select("text", "lang", "source", *packed))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = written(stats.select(*carried, *added[:6], failed.alias("base_failed"), *statistic_vector()))
    passed = stats.filter(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(P)])
    groups = small_side(written(groups_of(passed)).select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), "grp"), GROUP_ROWS)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(groups, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")), "left").drop("q_lang", "q_source")

    passed = grouped(passed).filter("grp IS NOT NULL").drop("lang", "source")
    estimate = small_side(written(start_estimate(passed)), GROUP_ROWS)
    for _ in range(STEPS):
        estimate = small_side(written(concentrate(passed, estimate)), GROUP_ROWS)
    judged = with_distance(grouped(stats), estimate)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)
    return judged.select(*[F.col(f"user_columns.`{c}`") if c in extras else F.col(c) for c in keep], *added[:7], "d2", kept.alias("kept"))


def op7_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("d2"))
