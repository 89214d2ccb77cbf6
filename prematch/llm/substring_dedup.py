"""Remove passages that also stand earlier: backward search in one compressed index per shard of passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, stored, text_batches
from .fm_index import FmIndex
from .key_filter import key_filter, passes
from .word_hashes import run_hashes, word_hashes

WINDOW = 20            # words
GRAM = 6               # words of an anchor: the least hash among the WINDOW - GRAM + 1 grams of a window
SHARD_WORDS = 1_000_000
HOT_WORDS = 400_000    # an anchor whose distinct passages have more words is spread over the shards window by window
LAST = np.iinfo(np.int64).max


def runs_of(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Cut the windows of a text into runs with the same anchor: (anchor, start, windows in the run, whether the anchor stands in it twice).

    A run can only repeat a window of its own if its anchor stands in it twice. Equal windows have equal anchors wherever they stand, so all that can be equal meets under its anchor.
    """
    if len(words) < window:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    grams = run_hashes(words, GRAM)
    least, have, want = grams, 1, window - GRAM + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.concatenate((start, [len(least)])))
    first = np.cumsum(n + want - 1) - (n + want - 1)
    own = grams[np.arange(int((n + want - 1).sum())) + np.repeat(start - first, n + want - 1)] == np.repeat(least[start], n + want - 1)
    return least[start], start, n, np.add.reduceat(own.astype(np.int64), first) > 1


def passage_hashes(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One hash per passage words[start:start + length]."""
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    flat = words[np.repeat(start, length) + place]
    power = np.cumprod(np.full(int(length.max(initial=1)), np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)
    return np.add.reduceat(flat * power[place], np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)


def text_words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace"))


def _met(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, met): how many runs each anchor has in a batch of texts, a run that holds it twice counting as two."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [runs_of(word_hashes(text.as_buffer() if text.is_valid else b""), window) for text in batch.column("text")]
            if parts:
                anchors, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                met = np.bincount(which, weights=1 + np.concatenate([p[3] for p in parts]), minlength=len(anchors))
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(met.astype(np.int64))], names=["anchor", "met"])

    return docs.select("text").mapInArrow(count, "anchor long, met long")


def _runs(docs: DataFrame, window: int, wanted) -> DataFrame:
    """(doc, rid, anchor, passage, start, n, twice) of the runs of every text whose anchor passes the broadcast filter; whole columns, as a
    corpus has a run every few words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for text in batch.column("text"):
                words = word_hashes(text.as_buffer() if text.is_valid else b"")
                anchor, start, n, twice = runs_of(words, window)
                kept = passes(wanted.value, anchor)
                anchor, start, n, twice = anchor[kept], start[kept], n[kept], twice[kept]
                parts.append((anchor.view(np.int64), passage_hashes(words, start, n + window - 1).view(np.int64), start.astype(np.int32), n.astype(np.int32), twice))
            which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            columns = [batch.column(c).take(pa.array(which)) for c in ("doc", "rid")]
            columns += [pa.array(np.concatenate([p[k] for p in parts])) if parts else pa.array([], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "rid", "anchor", "passage", "start", "n", "twice"])

    return docs.select("doc", "rid", "text").mapInArrow(cut, "doc long, rid long, anchor long, passage long, start int, n int, twice boolean")


def _passages(joined: DataFrame, window: int) -> DataFrame:
    """(anchor, passage, doc, start, words) of the wanted runs of each text; those of hot anchors window by window."""
    @F.pandas_udf("array<struct<anchor:long,passage:long,start:int,hot:boolean,words:binary>>")
    def taken(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            out = []
            for text, runs in zip(texts, wanted, strict=True):
                words, rows = text_words(text), []
                for r in runs:
                    own = words[r["start"]:r["start"] + r["n"] + window - 1]
                    if r["hot"]:
                        keys = run_hashes(own, window).view(np.int64).tolist()
                        rows += [{"anchor": k, "passage": k, "start": r["start"] + i, "hot": True, "words": own[i:i + window].tobytes()} for i, k in enumerate(keys)]
                    else:
                        rows.append({"anchor": r["anchor"], "passage": r["passage"], "start": r["start"], "hot": False, "words": own.tobytes()})
                out.append(rows)
            yield pd.Series(out)

    return joined.select("doc", "rid", F.inline(taken("text", "wanted")))


def search_shard(frame: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """(doc, rid, start, stop) of the words under windows that stand earlier in the shard.

    frame: doc, rid, start, words of distinct passages, each at its earliest place.
    """
    passages = [np.frombuffer(w, np.uint64) for w in frame["words"]]
    lengths = np.array([len(p) for p in passages])
    names, numbers = np.unique(np.concatenate(passages), return_inverse=True)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
    place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
    text[place] = numbers + 1
    index = FmIndex(text, window)
    # the order of places in the corpus: by document, then start; equal places of repeated ids rank alike
    doc, start = frame["doc"].to_numpy(np.int64), frame["start"].to_numpy(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    where = start[of] + place - starts[of]
    by = np.lexsort((where, doc[of]))
    new = np.concatenate(([0], ((np.diff(doc[of][by]) != 0) | (np.diff(where[by]) != 0)).astype(np.int64)))
    when = np.full(len(text), LAST, np.int64)
    when[place[by]] = np.cumsum(new)
    earliest = np.minimum.reduceat(when[index.order], index.groups)
    late = []
    for p, at, low in index.windows(text, starts, lengths, window):
        again = earliest[index.which[low]] < when[starts[p] + at]
        if again.any():
            late.append(np.stack((p[again], at[again])))
    if not late:
        return pd.DataFrame({"doc": [], "rid": [], "start": [], "stop": []}).astype({"doc": "int64", "rid": "int64", "start": "int64", "stop": "int64"})
    p, at = np.concatenate(late, axis=1)
    order = np.lexsort((at, p))
    p, at = p[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(at) > window))))
    last = np.concatenate((first[1:], [len(p)])) - 1
    return pd.DataFrame({"doc": doc[p[first]], "rid": frame["rid"].to_numpy(np.int64)[p[first]], "start": start[p[first]] + at[first], "stop": start[p[first]] + at[last] + window})


def covered_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, rid, start, stop): stretches of words under a window that also starts earlier; docs: doc, rid, text.

    1. Runs of windows are counted per anchor; only runs pass whose anchor, by a filter of bounded size, may be met twice. What the
       filter lets through by chance is alone with its anchor and goes no further than step 2.
    2. Among their runs, each distinct passage keeps its earliest place. Every later copy is covered as a whole.
    3. Distinct passages that share an anchor are gathered into shards by anchor, at their earliest places; a shard's index is
       searched for every window of its passages, and those with an earlier place are reported. An anchor whose passages have
       more than HOT_WORDS words is dealt window by window, equal windows combined first, so a shard stays near SHARD_WORDS.
    """
    twice = stored(_met(docs, window).groupBy("anchor").agg(F.sum("met").alias("met")).filter("met > 1").select("anchor"))
    hits = stored(_runs(docs, window, key_filter(twice, "anchor", twice.count())))
    passages = hits.groupBy("anchor", "passage").agg(F.min(F.struct("doc", "start", "rid")).alias("first"), F.max("n").alias("n"), F.max("twice").alias("twice"))
    passages = stored(passages)
    later = hits.join(passages.select("anchor", "passage", "first").hint("merge"), ["anchor", "passage"])
    later = later.filter((F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("start") > F.col("first.start"))))
    later = later.select("doc", "rid", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + (window - 1)).cast("long").alias("stop"))

    several = passages.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long") + (window - 1)).alias("words"), F.max("twice").alias("again")).filter((F.col("m") > 1) | F.col("again"))
    wanted = stored(passages.join(several.hint("merge"), "anchor").select("first.doc", "first.rid", F.struct("anchor", "passage", F.col("first.start").alias("start"), "n", (F.col("words") > HOT_WORDS).alias("hot")).alias("run")))
    sums = wanted.agg(F.sum(F.col("run.n") + (window - 1)).alias("words"), F.sum(F.when(F.col("run.hot"), F.col("run.n") * window)).alias("hot")).first()
    per_doc = wanted.groupBy("doc", "rid").agg(F.collect_list("run").alias("wanted"))  # as long as the text at most
    found = stored(_passages(docs.join(per_doc.hint("shuffle_hash"), ["doc", "rid"]), window), compression="zstd")
    hot = found.filter("hot").groupBy("anchor", "passage").agg(F.min(F.struct("doc", "start", "rid")).alias("first"), F.first("words").alias("words"))
    hot_later = found.filter("hot").join(hot.select("anchor", "first").hint("merge"), "anchor").filter((F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("start") > F.col("first.start"))))
    out = later.unionByName(hot_later.select("doc", "rid", F.col("start").cast("long").alias("start"), (F.col("start") + window).cast("long").alias("stop")))
    every = found.filter("NOT hot").select("anchor", "doc", "rid", "start", "words").unionByName(hot.select("anchor", "first.doc", "first.rid", "first.start", "words"))
    shards = int(((sums["words"] or 0) + (sums["hot"] or 0)) // SHARD_WORDS) + 1
    searched = (every.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).groupBy("shard")
                .applyInPandas(lambda frame: search_shard(frame, window), "doc long, rid long, start long, stop long"))
    return out.unionByName(searched)


def _with_keys(docs: DataFrame) -> DataFrame:
    """docs with doc (the id, null last) and rid (tells apart rows that repeat an id with another text; 0 where no id is repeated).
    Ids that are no whole numbers are numbered in their own order."""
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    rid = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        known = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy("doc_id")
        docs = docs.join(stored(known.withColumn("doc", F.monotonically_increasing_id())), "doc_id", "left")
    else:
        docs = docs.withColumn("doc", F.col("doc_id").cast("long"))
    return docs.withColumns({"doc": F.coalesce("doc", F.lit(LAST)), "rid": rid})


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per row of docs; kept is the remaining words joined by one space.

    A word is removed if it lies in a window of ``window`` words that also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. Words are compared by 64-bit hashes. Null, empty and short texts lose nothing.
    A null doc_id comes last (as the greatest long, which stands for null); rows that repeat an id are ordered by start alone. Ids that are
    no whole numbers are compared by their own order, strings by their bytes. No rows: no rows.
    """
    text_batches(docs.sparkSession)
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    keyed = _with_keys(docs.select("doc_id", "text")).select("doc", "rid", "text", *([] if whole else ["doc_id"]))
    gone = covered_words(keyed, window).groupBy("doc", "rid").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            out = []
            for text, spans in zip(texts, gone, strict=True):
                words = (text or "").encode("utf-8", "replace").split()  # bytes: splits at the six white characters only
                keep = np.ones(len(words) + 1, bool)
                for s in spans if spans is not None else ():
                    keep[s["start"]:s["stop"]] = False
                kept = [w for w, k in zip(words, keep, strict=False) if k] if not keep.all() else words
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    joined = keyed.join(gone.hint("shuffle_hash"), ["doc", "rid"], "left")
    return joined.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id") if whole else "doc_id", cut("text", "gone").alias("c")).select("doc_id", "c.*")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = kept_words(read_table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
