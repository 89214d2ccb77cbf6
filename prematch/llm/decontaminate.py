"""Remove benchmark passages from training text (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_key, small_side, written

# A benchmark word is a run of digits, letters and anything beyond ASCII, with A-Z lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_WINDOWS = 1_000_000  # about 150 bytes each


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LOWERED_WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, len, key, gram): each window of each item once; a shorter item is one window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    grams = items.select("item_id", F.explode(F.transform(starts, lambda p: F.slice("w", p, window))).alias("g"))
    return grams.select("item_id", F.size("g").alias("len"), F.xxhash64("g").alias("key"), F.array_join("g", " ").alias("gram")).distinct()


def document_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row_key, at, len, gram): where a document's words spell a benchmark window.

    The documents are scanned in place: every window's hash meets the broadcast set of benchmark hashes. Where hashes
    agree, the words themselves are compared. A benchmark beyond BROADCAST_WINDOWS is joined by a shuffle instead, with the same rows.
    """
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most WINDOW values
    known = small_side(windows.select(F.col("len").alias("known_len"), F.col("key").alias("known_key"), F.col("gram")).distinct(), BROADCAST_WINDOWS)
    words = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), normal_words(F.col("text")).alias("w"))

    def windows_of(n: int) -> DataFrame:
        keys = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda p: F.xxhash64(F.slice("w", p, n)))
        rows = words.select("row_key", F.when(F.size("w") >= n, keys).alias("keys"))
        # outer, as posexplode adds a filter on the array's size, which is pushed down and computes the array again there
        return rows.select("row_key", F.posexplode_outer("keys").alias("at", "key")).withColumn("len", F.lit(n))

    parts = [windows_of(n) for n in lengths]
    if not parts:
        return words.limit(0).select("row_key", F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("gram"))
    scanned = parts[0]
    for part in parts[1:]:
        scanned = scanned.unionByName(part)
    same = (F.col("key") == F.col("known_key")) & (F.col("len") == F.col("known_len"))
    found = written(scanned.join(known, same).select("row_key", "at", "len", "gram"))
    # the words of the few documents with hits, to compare them with the benchmark's
    there = words.join(found.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
    spans = found.groupBy("row_key").agg(F.collect_set(F.struct("at", "len", "gram")).alias("spans"))
    spelled = F.filter("spans", lambda s: F.array_join(F.slice("w", s["at"] + 1, s["len"]), " ") == s["gram"])
    return spans.join(there, "row_key").select("row_key", spelled.alias("spans")).select("row_key", F.inline("spans"))


def covered(spans: Column) -> Column:
    """Words under the union of (at, len) spans sorted by at."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))

    def add(state, span):
        end = F.greatest(state["reach"], span["at"] + span["len"])
        return F.struct((state["n"] + end - F.greatest(state["reach"], span["at"])).cast("long").alias("n"), end.alias("reach"))
    # a span that starts at or before reach adds what lies beyond it; at <= end always holds
    return F.aggregate(spans, zero, add, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """Per distinct (doc_id, text): row_key, n_rows, n_words, spans, n_hit, items and contaminated (n_hit > 0 and one_in * n_hit >= n_words).

    Null and empty texts have no words and no hits. A null doc_id is a value of its own. Repeated rows share one result,
    which fits each. An item without an id marks words as hit but is not listed. An empty benchmark hits nothing.
    """
    windows = item_windows(benchmark, window)
    hits = written(document_hits(docs, windows))
    spans = hits.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"))
    found = (hits.select("row_key", "gram").distinct()
             .join(windows.select("gram", F.col("item_id").cast("string").alias("item")).distinct(), "gram")
             .groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")
    counted = (docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), n_words.alias("n_words"))
               .groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("*").alias("n_rows")))
    joined = counted.join(spans, "row_key", "left").join(found, "row_key", "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return joined.select("row_key", "doc_id", "n_words", "n_rows", "spans", n_hit.alias("n_hit"), items.alias("items"),
                         ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"))


def _with_verdict(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    found = contamination(docs, benchmark, **settings).filter("n_hit > 0").select(F.col("row_key").alias("dec_key"), F.col("spans").alias("dec_spans"), F.col("contaminated").alias("dec_out"))
    return docs.join(found, row_key(docs["doc_id"], docs["text"]) == F.col("dec_key"), "left")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without the contaminated ones."""
    return _with_verdict(docs, benchmark, **settings).filter(~F.coalesce(F.col("dec_out"), F.lit(False))).select(*[docs[c] for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs with every hit word, and what stands between it and the next word, cut out of the text."""
    marked = _with_verdict(docs, benchmark, **settings)
    piece = F.regexp_extract_all(F.col("text"), F.lit(f"{ANY_CASE_WORD}{ANY_CASE_WORD.replace('[^', '[').replace('+', '*')}"), F.lit(0))
    lead = F.regexp_extract(F.col("text"), f"^{ANY_CASE_WORD.replace('[^', '[').replace('+', '*')}", 0)
    kept = F.filter(piece, lambda _, i: ~F.exists(F.col("dec_spans"), lambda s: (s["at"] <= i) & (i < s["at"] + s["len"])))
    text = F.when(F.col("dec_spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return marked.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    judged = contamination(read_table(spark, folder, "documents").select("doc_id", "text"), read_table(spark, folder, "benchmark"))
    judged = judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_rows")
    return judged.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("n_rows", "row")


OP6_SQL = r"""
WITH lo AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM lo WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
hits AS (SELECT rid, pos, p.n, item_id FROM p JOIN grams ON grams.n = p.n AND grams.g = array_to_string(p.w[pos:pos + p.n - 1], ' ')),
hw AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS x FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""
