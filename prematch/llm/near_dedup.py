"""Near-duplicate texts: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_key, stored, text_batches, written
from .components import components
from .word_hashes import NOT_WORD, mix, run_hashes, word_hashes

SHINGLE = 5            # words: lower-cased runs of ASCII digits and letters and of anything beyond ASCII
SIMILAR = 0.8
BANDS, ROWS = 12, 4    # texts that agree by s share a band with 1 - (1 - s ** 4) ** 12: 0.998 at 0.8
SKETCH = 1 << 18       # counters of document frequency; each shingle counts in one of them
IDF_POWER = 0.125      # a large group of near copies makes its own shingles frequent; undamped, what sets its members apart would outweigh what they share
FEW = 64               # members up to which the pairs of a band come from a join; those of a larger one from blocks of it
BLOCK = 512            # members of a large band in one block
PROFILE = 512          # counters of weight by shingle, from which an upper bound of the similarity follows

_RNG = np.random.default_rng(8)
_SEEDS = _RNG.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_R = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_LOW = np.uint64(0xFFFF)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(run_hashes(word_hashes(text.encode("utf-8", "replace"), NOT_WORD, lower=True), SHINGLE), return_counts=True)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[(found & np.uint64(SKETCH - 1)).astype(np.int64)]


def samples(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """BANDS * ROWS improved consistent weighted samples: two texts agree in each with probability their weighted Jaccard similarity."""
    best, at = np.full(len(_SEEDS), np.inf, np.float32), np.zeros(len(_SEEDS), np.uint64)
    logs = np.log(weight)
    for i in range(0, len(found), 1024):  # the whole text, in pieces that stay in cache
        own, lw = found[i:i + 1024], logs[i:i + 1024]
        h = mix(own[None, :] ^ _SEEDS)
        r = _R[(h & _LOW).astype(np.int32)]
        beta = ((h >> np.uint64(32)) & _LOW).astype(np.float32) / 65536
        t = np.floor(lw / r + beta)
        a = _LOG_C[((h >> np.uint64(16)) & _LOW).astype(np.int32)] - r * (t - beta) - r
        k = a.argmin(axis=1)
        rows = np.arange(len(_SEEDS))
        better = a[rows, k] < best
        best = np.where(better, a[rows, k], best)
        at = np.where(better, mix(own[k] + t[rows, k].astype(np.int64).astype(np.uint64)), at)
    return at


def band_keys(sample: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out ^ sample.reshape(BANDS, ROWS)[:, j]) + np.uint64(j)
    return out.view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard of two (hashes, weights)."""
    (fa, wa), (fb, wb) = a, b
    if not len(fa) or not len(fb):
        return 0.0
    _, ia, ib = np.intersect1d(fa, fb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[ia], wb[ib]).sum())
    return low / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - low)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Damped inverse document frequency per counter, from all documents; SKETCH numbers whatever the size of the corpus."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found, _ = shingles(text)
                total += np.bincount(np.unique(found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) if len(found) > SKETCH // 8 else 0
                if 0 < len(found) <= SKETCH // 8:
                    total[np.unique(found & np.uint64(SKETCH - 1)).astype(np.int64)] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"counter": np.append(some, -1), "n": np.append(total[some], n)})

    rows = docs.select("text").mapInPandas(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SKETCH)
    n = int(rows.loc[rows["counter"] < 0, "n"].sum())
    rows = rows[rows["counter"] >= 0]
    df[rows["counter"].to_numpy(int)] = rows["n"]
    return ((1.0 + np.log((n + 1) / np.maximum(df, 1))) ** IDF_POWER).astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, row_key, node, keys): node stands for the normalised words, so copies share it; keys are its band keys (none without a word)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # SKETCH floats

    @F.pandas_udf("node string, keys array<long>")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for text in batch:
                words = word_hashes((text or "").encode("utf-8", "replace"), NOT_WORD, lower=True)
                if not len(words):
                    out.append((None, []))
                    continue
                found, counts = np.unique(run_hashes(words, SHINGLE), return_counts=True)
                out.append((hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest(), band_keys(samples(found, weights(found, counts, shared.value)))))
            yield pd.DataFrame(out, columns=["node", "keys"])

    return docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), signed("text").alias("s")).select("doc_id", "row_key", "s.*")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts agree by at least similar. texts: node, text."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, seen = None, None
        for node, left, right in batches:
            out = []
            for n, a, b in zip(node, left, right, strict=True):
                if n != last:  # rows arrive sorted by b, so a leader's text is taken apart once
                    found, counts = shingles(b)
                    last, seen = n, (found, weights(found, counts, shared.value))
                found, counts = shingles(a)
                out.append(similarity((found, weights(found, counts, shared.value)), seen) >= similar)
            yield pd.Series(out)

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right.hint("merge"), "b")
    return joined.filter(alike("b", "text_a", "text_b")).select("a", "b")


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member (key, node, weight) of a key against the key's heaviest node, the centre of its group if there is one."""
    leaders = members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b")
    return members.join(leaders, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def mixed(members: DataFrame) -> DataFrame:
    """members (key, node, label) of the keys that hold more than one label, with the number n of members."""
    keys = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n")
    return members.join(keys, "key")


def cross_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of all members of a key that have different labels; members (key, node, label)."""
    other = members.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    return members.join(other, "key").filter((F.col("node") > F.col("b")) & (F.col("label") != F.col("label_b"))).select(F.col("node").alias("a"), "b").distinct()


def profile(found: np.ndarray, weight: np.ndarray) -> bytes:
    """The weight of the shingles in each of PROFILE counters, as half floats rounded up (infinite beyond their range)."""
    exact = np.bincount((found >> np.uint64(40)).astype(np.int64) % PROFILE, weights=weight, minlength=PROFILE)
    with np.errstate(over="ignore"):
        out = exact.astype(np.float16)
    return np.where(out < exact, np.nextafter(out, np.float16(np.inf)), out).astype(np.float16).tobytes()


def bounds(one: np.ndarray, total: float, others: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """No similarity of one to the others is above these: two texts share at most the lesser weight of each counter."""
    low = np.minimum(np.minimum(one, others).sum(axis=1, dtype=np.float64), np.minimum(total, totals))
    return low / (total + totals - low)


def profiles(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, total, profile) of texts (node, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    @F.pandas_udf("total double, profile binary")
    def profiled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                found, counts = shingles(text)
                weight = weights(found, counts, shared.value)
                out.append((float(weight.sum(dtype=np.float64)), profile(found, weight)))
            yield pd.DataFrame(out, columns=["total", "profile"])

    return texts.select("node", profiled("text").alias("p")).select("node", "p.*")


def block_pairs(members: DataFrame, signed: DataFrame, similar: float) -> DataFrame:
    """(a, b, bound): the pairs of members of a key with different labels that no bound rules out, each at the first band that it shares.

    members: key, node, label, n; signed: node, keys, total, profile. A key is dealt into blocks of about BLOCK nodes, and every
    two blocks of it meet in one group, so neither a task nor a table grows with the square of a band's members.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = members.join(signed, "node").select("key", "node", "label", "keys", "total", "profile", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("key", "node", "label", "keys", "total", "profile", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.stack(rows["keys"].to_numpy()).astype(np.int64)
        band = int((keys[0] == rows["key"].iloc[0]).argmax())
        seen = np.frombuffer(b"".join(rows["profile"]), np.float16).reshape(len(rows), PROFILE).astype(np.float32)
        total, label, node = rows["total"].to_numpy(), pd.factorize(rows["label"])[0], rows["node"].to_numpy()
        left = np.flatnonzero(rows["own"] == rows["low"].iloc[0])
        right = np.flatnonzero(rows["own"] == rows["high"].iloc[0])
        out = []
        for i in left:
            js = right[right > i] if rows["low"].iloc[0] == rows["high"].iloc[0] else right
            js = js[label[js] != label[i]]
            js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
            bound = bounds(seen[i], total[i], seen[js], total[js])
            good = bound >= similar - 1e-5  # similarities are sums of single floats
            out += [(max(node[i], node[j]), min(node[i], node[j]), float(v)) for j, v in zip(js[good], bound[good], strict=True)]
        return pd.DataFrame(out, columns=["a", "b", "bound"])

    return rows.groupBy("key", "low", "high").applyInPandas(compared, "a string, b string, bound double")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, row_key, label, class_id, n_class): one row per row of docs; class_id is the least doc_id of its class, label its name.

    Texts with the same normalised words are one node. Nodes that share a band are linked where their weighted Jaccard
    similarity is at least ``similar``, and classes are the connected components. Links are looked for in three rounds,
    each of which compares only what the rounds before have not joined:

    1. every node against the heaviest node of each of its bands, the one that shares most with others: linear in the rows, and enough for groups of copies;
    2. of all pairs from different components that share a band, whatever its size, and that their profiles do not rule
       out (bands of more than FEW nodes), each node with the one it has the highest bound with;
    3. all the others of these pairs.

    So no pair that shares a band goes uncompared unless it is in one component already or provably below ``similar``.

    Texts without a word (null, empty) are classes of their own per row. Repeated rows are one node. A null doc_id counts only where
    a class has no other. No rows: no rows.
    """
    text_batches(docs.sparkSession)
    idf = document_frequency(docs)
    signed = stored(signatures(docs, idf))
    nodes = stored(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    members = nodes.select("node", "copies", F.explode("keys").alias("key"))
    shared = stored(members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"))
    # a text that many others were made from shares bands with all of them, while they share few with each other
    weight = shared.groupBy("node").agg((F.sum("n") + F.first("copies")).alias("weight"))
    shared = shared.join(weight, "node").select("key", "node", "weight")
    wanted = nodes.join(weight.select("node"), "node", "left_semi").select("row_key", "node")
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").join(wanted.hint("shuffle_hash"), "row_key").dropDuplicates(["node"]).select("node", "text")
    texts = stored(texts)

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    links = stored(verified(star_pairs(shared), texts, idf, similar))
    labels = components(links)
    open_ = stored(mixed(labelled(shared, labels)))
    if not open_.isEmpty():
        rest = cross_pairs(open_.filter(F.col("n") <= FEW).select("key", "node", "label")).withColumn("bound", F.lit(1.0))
        large = open_.filter(F.col("n") > FEW).select("key", "node", "label", "n")
        if not large.isEmpty():
            who = large.select("node").distinct()
            seen = profiles(texts.join(who, "node", "left_semi"), idf).join(nodes.select("node", "keys"), "node")
            rest = rest.unionByName(block_pairs(large, seen, similar))
        rest = stored(rest.groupBy("a", "b").agg(F.max("bound").alias("bound")))
        nearest = stored(rest.groupBy("a").agg(F.max_by("b", F.struct("bound", "b")).alias("b")))
        links = links.unionByName(stored(verified(nearest, texts, idf, similar)))
        labels = components(links)
        named = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        rest = rest.join(nearest, ["a", "b"], "left_anti").join(named[0], "a", "left").join(named[1], "b", "left")
        last = stored(verified(rest.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), texts, idf, similar))
        if not last.isEmpty():
            labels = components(links.unionByName(last))
    own = labelled(signed.select("doc_id", "row_key", F.coalesce("node", F.concat(F.lit("none "), F.col("row_key"), F.lit(" "), F.monotonically_increasing_id())).alias("node")), labels)
    sums = own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    return own.join(sums, "label").select("doc_id", "row_key", "label", "class_id", "n_class")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without the near-duplicates: of each class one row with the least doc_id stays."""
    found = written(classes(docs, similar).filter("n_class > 1"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    out = found.filter(~first).select("row_key")
    again = found.filter(first).groupBy("label").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key")).filter("n > 1").select("row_key", "label")
    keyed = docs.withColumn("ded_key", row_key(F.col("doc_id"), F.col("text")))
    if again.isEmpty():
        return keyed.join(out.distinct().withColumnRenamed("row_key", "ded_key"), "ded_key", "left_anti").select(*docs.columns)
    # rows that repeat the least doc_id of their class: all of them go, then one comes back
    rows = found.filter(first).join(again.select("label"), "label", "left_semi").select("row_key")
    rest = keyed.join(out.unionByName(rows).distinct().withColumnRenamed("row_key", "ded_key"), "ded_key", "left_anti").select(*docs.columns)
    one = keyed.join(again.select(F.col("row_key").alias("ded_key")), "ded_key", "left_semi").dropDuplicates(["ded_key"])
    return rest.unionByName(one.select(*docs.columns))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(read_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_class", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
