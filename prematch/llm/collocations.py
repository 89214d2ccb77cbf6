"""Phrases of two to four words that occur together more often than their parts would."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, stored, text_batches
from .hat_trie import MAX_ENTRIES, HatTrie, key_hashes
from .key_filter import key_filter, passes
from .word_hashes import LOWER, mix, word_hashes

LEAST = 30            # a candidate occurs at least so often
LONGEST = 4
TOP = 2000            # phrases reported per language
COVERED = 80          # percent of a candidate's occurrences that a longer candidate must have to drop it
CHUNK = 1 << 22       # bytes that are split into words at once; longer texts are cut where pieces end
HOT_PREFIX = 1 / 1000    # a first pair with more than this share of all words has its phrases dealt out by their later words too
RANK_BUCKETS = 256
TRIES = 4             # seeds of word ids to try, should two words of a language get one id
# What ends a piece, and what parts the words of one.
PIECE_END = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
PARTS = PIECE_END | np.array([b in (9, 32) for b in range(256)])
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _chunks(texts: list[bytes]):
    """The texts, each ended by a line feed, in buffers of about CHUNK bytes."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > CHUNK and (end := _CUT.search(text, at + CHUNK)):
            yield text[at:end.end()]
            at = end.end()
        held.append(text[at:])
        size += len(text) - at
        if size >= CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def _by_language(batch):
    """(language, its texts as bytes) of a batch; null texts are left out."""
    texts: dict[str, list[bytes]] = {}
    for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
        if text:
            texts.setdefault("und" if lang is None else lang, []).append(text)
    return texts.items()


def _language_key(lang: str, seed: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "big"))


def _ids(data: bytes, key: np.uint64) -> np.ndarray:
    """Ids of the words of a language: a word has another id in another language, so keys of ids need no language beside them. Never 0."""
    return mix(word_hashes(data, PARTS, lower=True) ^ key) | np.uint64(1)


def _edges(data: bytes):
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~PARTS[a], [False])).view(np.int8)
    at = np.flatnonzero(np.diff(inside))
    return at[::2], at[1::2], a


def _signed(column: np.ndarray):
    return pa.array(column.view(np.int64))


def _word_runs(batches, seed, max_entries):
    trie, seen = HatTrie(1, max_entries), np.zeros(0, np.uint64)

    def counted(keys, counts):
        return pa.RecordBatch.from_arrays([_signed(keys[0]), pa.nulls(len(counts), pa.string()), pa.nulls(len(counts), pa.string()), pa.array(counts)], names=["w1", "lang", "word", "n"])

    for batch in batches:
        for lang, texts in _by_language(batch):
            key = _language_key(lang, seed)
            for data in _chunks(texts):
                ids = _ids(data, key)
                if not len(ids):
                    continue
                distinct, first = np.unique(ids, return_index=True)
                new = ~np.isin(distinct, seen, assume_unique=True)
                if new.any():  # the spelling goes out once per task, with no count
                    starts, ends, a = _edges(data)
                    lowered = LOWER[a].tobytes()
                    words = [lowered[starts[i]:ends[i]].decode("utf-8") for i in first[new].tolist()]
                    fresh = distinct[new]
                    yield pa.RecordBatch.from_arrays([_signed(fresh), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(np.zeros(len(words), np.int64))], names=["w1", "lang", "word", "n"])
                    seen = np.concatenate((seen, fresh)) if len(seen) < max_entries else fresh
                for run in trie.add(ids[None, :]):
                    yield counted(*run)
    for run in trie.drain():
        yield counted(*run)


def _phrase_runs(batches, seed, lengths, max_entries, filter_, hot):
    """Runs of the phrases of the given lengths all of whose parts of the length below may be frequent, by the filter."""
    width, part, bits = max(lengths), min(lengths) - 1, filter_.value
    trie = HatTrie(width, max_entries)
    names = [f"w{i + 1}" for i in range(width)] + ["deal", "n"]

    def out(keys, counts):
        deal = np.zeros(len(counts), np.uint64)
        if width > 2:
            spread = np.isin(key_hashes(keys[:2]), hot)
            deal[spread] = key_hashes(keys[2:][:, spread])
        return pa.RecordBatch.from_arrays([*(_signed(k) for k in keys), _signed(deal), pa.array(counts)], names=names)

    for batch in batches:
        for lang, texts in _by_language(batch):
            key = _language_key(lang, seed)
            for data in _chunks(texts):
                ids = _ids(data, key)
                starts, _, a = _edges(data)
                piece = np.cumsum(PIECE_END[a])[starts] if len(starts) else starts
                n = len(ids) - part + 1
                if n < 2:
                    continue
                ok = passes(bits, key_hashes(np.stack([ids[j:j + n] for j in range(part)])))
                keys = []
                for k in lengths:
                    m = len(ids) - k + 1
                    if m < 1:
                        continue
                    keep = piece[:m] == piece[k - 1:]
                    for j in range(k - part + 1):
                        keep &= ok[j:j + m]
                    at = np.flatnonzero(keep)
                    full = np.zeros((width, len(at)), np.uint64)
                    for j in range(k):
                        full[j] = ids[at + j]
                    keys.append(full)
                if keys:
                    for run in trie.add(np.concatenate(keys, axis=1)):
                        yield out(*run)
    for run in trie.drain():
        yield out(*run)


def _filter_of(frequent: DataFrame, columns: list[str]):
    """A bounded filter of the hashes of the frequent keys."""
    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(key_hashes(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns])))], names=["key"])

    return key_filter(frequent.select(*columns).mapInArrow(hashed, "key long"), "key", frequent.count())


def _words(texts: DataFrame, max_entries: int) -> tuple[DataFrame, int]:
    """Every word of every language with its id and count, and the seed of the ids. Ids are hashes: should two words share one, another seed is taken."""
    for seed in range(TRIES):
        runs = texts.mapInArrow(lambda batches, seed=seed: _word_runs(batches, seed, max_entries), "w1 long, lang string, word string, n long")
        spelled = F.struct("lang", "word")
        words = stored(runs.groupBy("w1").agg(F.sum("n").alias("n"), F.min(F.when(F.col("word").isNotNull(), spelled)).alias("least"), F.max(F.when(F.col("word").isNotNull(), spelled)).alias("most")))
        if words.filter(F.col("least") != F.col("most")).isEmpty():
            return words.select("w1", "n", "least.lang", "least.word"), seed
    raise ValueError(f"words share ids under {TRIES} seeds")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, max_entries: int = MAX_ENTRIES, hot_prefix: float = HOT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): every word of every language with its id w1, lang, word and count n; every phrase of 1 to ``longest`` words that
    occurs at least ``least`` times, as ids (array of word ids; they tell the language) and f.

    Three scans: words, pairs of frequent words, longer phrases of frequent pairs. Each task counts in its own trie and spills sorted
    subtrees; runs are merged where their first two words send them, those of very frequent pairs also by their later words.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    words, seed = _words(texts, max_entries)
    frequent = words.filter(F.col("n") >= least)
    found = [frequent.select(F.array("w1").alias("ids"), F.col("n").alias("f"))]
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.zeros(0, np.uint64)
    part, columns = frequent, ["w1"]
    for lengths in ([2], list(range(3, longest + 1))):
        if not [k for k in lengths if k <= longest]:
            continue
        shared = _filter_of(part, columns)
        columns = [f"w{i + 1}" for i in range(max(lengths))]
        schema = ", ".join(f"{c} long" for c in [*columns, "deal", "n"])
        runs = texts.mapInArrow(lambda batches, k=lengths, s=shared, h=hot: _phrase_runs(batches, seed, k, max_entries, s, h), schema)
        merged = runs.repartition("w1", "w2", "deal").groupBy("w1", "w2", "deal", *columns[2:]).agg(F.sum("n").alias("f"))
        part = stored(merged.filter(F.col("f") >= least).drop("deal"))
        used = F.array(*[F.col(c) for c in columns])
        found.append(part.select(F.filter(used, lambda w: w != 0).alias("ids"), "f"))
        if lengths == [2]:  # at most 1 / hot_prefix pairs have that share
            rows = part.filter(F.col("f") > hot_prefix * total).select("w1", "w2").toArrow()
            hot = key_hashes(np.stack([rows[c].to_numpy().view(np.uint64) for c in ("w1", "w2")]))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return words, phrases


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, **settings) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Score of a cut: floor(2000000 * a / (l + r)), with a the count of the phrase and l and r those of its parts; the lowest cut counts, of equal
    ones the first. A phrase that lies inside a longer candidate with ``covered`` percent of its occurrences is dropped. Whole numbers throughout.

    Null or empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur. Ties: by score, count, then the
    bytes of the phrase. No rows, or none frequent enough: no rows. Long texts are worked on in chunks. Columns other than
    text and lang are not read.
    """
    words, phrases = phrase_counts(docs, least, longest, **settings)
    size = F.size("ids")
    candidates = phrases.filter(size >= 2)
    inside = (candidates.filter(size >= 3)
              .select(F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), s -> slice(ids, s, n))))")).alias("ids"), "f")
              .groupBy("ids").agg(F.max("f").alias("longer")))
    kept = (candidates.join(inside, "ids", "left")
            .filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(covered).cast("decimal(20,0)") * F.col("f")))
            .select("ids", F.col("f").alias("a")))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    scored = (cuts.join(phrases.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
              .join(phrases.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
              .withColumn("score", F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long"))
              .groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spelling = words.filter(F.col("n") >= least).select(F.col("w1").alias("id"), "lang", "word")
    spelled = (scored.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(spelling, "id")
               .groupBy("ids").agg(F.first("a").alias("a"), F.first("cut").alias("cut"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words")))
    rows = spelled.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # each language is ranked in RANK_BUCKETS parts; what could be among its first comes together then, at most RANK_BUCKETS * top rows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
    best_first = F.desc("score"), F.desc("a"), F.col("phrase")
    in_bucket, in_language = W.partitionBy("lang", "bucket").orderBy(*best_first), W.partitionBy("lang").orderBy(*best_first)
    rows = rows.withColumn("rank", F.row_number().over(in_bucket)).filter(F.col("rank") <= top)
    best = rows.withColumn("rank", F.row_number().over(in_language)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read_table(spark, folder, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(ws) - n + 2), lambda s: ws[s:s + n - 1])))) AS ph FROM w WHERE len(ws) > 0),
f AS (SELECT lang, ph, len(ph) AS size, count(*)::BIGINT AS f FROM g GROUP BY lang, ph HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE size >= 2),
s AS (SELECT lang, unnest(flatten(list_transform(range(2, size), lambda n: list_transform(range(1, size - n + 2), lambda s: ph[s:s + n - 1])))) AS ph, f AS longer FROM c WHERE size >= 3),
m AS (SELECT lang, ph, max(longer) AS longer FROM s GROUP BY lang, ph),
k AS (SELECT c.lang, c.ph, c.size, c.f AS a FROM c LEFT JOIN m ON c.lang = m.lang AND c.ph = m.ph WHERE m.longer IS NULL OR 100 * m.longer::HUGEINT < 80 * c.f::HUGEINT),
x AS (SELECT lang, ph, a, size, unnest(range(1, size)) AS k FROM k),
y AS (SELECT x.lang, x.ph, x.a, x.k, l.f AS l, r.f AS r, (2000000 * x.a::HUGEINT // (l.f::HUGEINT + r.f::HUGEINT))::BIGINT AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.ph = x.ph[1:x.k] JOIN f AS r ON r.lang = x.lang AND r.ph = x.ph[x.k + 1:x.size]),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS cut FROM y),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM z WHERE cut = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT b.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM b JOIN t ON b.lang = t.lang WHERE rank <= 2000
"""
