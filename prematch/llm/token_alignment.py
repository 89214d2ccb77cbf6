"""Align the tokens of two tokenizers by the bytes they cover, and count linked id pairs over the corpus."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, stored, text_batches
from .vocabularies import byte_level, pieces, public_path

HOT_PAIRS = 1_000_000   # the most frequent irregular pairs, at most so many, are broadcast; the others go through a shuffled join
NO_PAIR = -1
GROUP_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string"
COUNT_COLUMNS = "row_id long, {id} n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, other array<long>, other_n array<int>"


class Aligner:
    """Both tokenizers, their byte tables, and the B id with the same bytes as each A id (NO_PAIR where there is none)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_level(a_path, True), pieces(b_path)
        by_bytes = {token: i for i, token in reversed(list(enumerate(self.b.bytes))) if token}
        self.twin = np.array([by_bytes.get(token, NO_PAIR) for token in self.a.bytes], np.int64)
        # group texts are pieced together from the decimal ids with the mark that follows each
        size_a, size_b = self.a.size, self.b.size
        self.marks = [f"{i}," for i in range(size_a)] + [f"{i}|" for i in range(size_a)] + [f"{i}," for i in range(size_b)] + [f"{i};" for i in range(size_b)]

    def tokens(self, text: str | None):
        """Ids by A and B, or two empty arrays where a side does not give back the bytes of the text with a space before it."""
        nothing = np.zeros(0, np.int64)
        if not text:
            return nothing, nothing
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text), self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != whole or b"".join(map(self.a.bytes.__getitem__, a)) != whole:
            return nothing, nothing
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, text: str | None):
        """(A ids, B ids, group of each A token, group of each B token, links as (A place, B place)); a link joins tokens whose bytes overlap."""
        a, b = self.tokens(text)
        if not len(a):
            return a, b, a, a, (a, a)
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        is_a, is_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        ends = np.flatnonzero(is_a | is_b)            # every stretch between two ends lies in one A and one B token: one link
        stops_a, stops_b = is_a[ends], is_b[ends]
        link_a, link_b = np.cumsum(stops_a) - stops_a, np.cumsum(stops_b) - stops_b
        both = stops_a & stops_b
        group = np.cumsum(both) - both
        return a, b, group[stops_a], group[stops_b], (link_a, link_b)

    def group_text(self, a, b, group_a, group_b) -> str:
        """Groups as a1,a2|b1;a3|b2,b3 in order."""
        if not len(a):
            return ""
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        marks = np.empty(len(a) + len(b), np.int64)
        # in reading order an A token has before it the A tokens before it and the B tokens of earlier groups
        per_b, per_a = np.bincount(group_b), np.bincount(group_a)
        marks[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = a + last_a * self.a.size
        marks[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * self.a.size + b + last_b * self.b.size
        return "".join(map(self.marks.__getitem__, marks.tolist()))[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _paths(a_path, b_path):
    return a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model")


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id with n_a, n_b, n_groups, n_links and the groups themselves as text, one row per document."""
    paths = _paths(a_path, b_path)

    def run(batches):
        align = aligner(*paths)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                a, b, group_a, group_b, links = align.align(text)
                rows.append((len(a), len(b), int(group_a[-1]) + 1 if len(a) else 0, len(links[0]), align.group_text(a, b, group_a, group_b)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    text_batches(docs.sparkSession)
    id_field = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, T.StructType(id_field.fields + T.StructType.fromDDL(GROUP_COLUMNS).fields))


def _lists(parts, kind):
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind))


def _distinct(codes):
    """Distinct values and how often each occurs (by a sort and its steps, quicker on short arrays than np.unique)."""
    if not len(codes):
        return codes, codes
    codes = np.sort(codes)
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[at], np.diff(np.append(at, len(codes)))


def _document_counts(batches, paths):
    align, number = aligner(*paths), itertools.count(TaskContext.get().partitionId() << 40)
    for batch in batches:
        sizes, digests, same, same_n, other, other_n = [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            a, b, group_a, group_b, (link_a, link_b) = align.align(text)
            sizes.append((len(a), len(b), int(group_a[-1]) + 1 if len(a) else 0, len(link_a)))
            digests.append(hashlib.sha256(align.group_text(a, b, group_a, group_b).encode()).hexdigest() if len(a) else "")
            left, right = a[link_a], b[link_b]
            regular = align.twin[left] == right
            ids, n = _distinct(left[regular])
            same.append(ids)
            same_n.append(n)
            ids, n = _distinct((left[~regular] << 32) | right[~regular])
            other.append(ids)
            other_n.append(n)
        rows = [next(number) for _ in sizes]
        columns = list(zip(*sizes)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()),
             _lists(same, pa.int32()), _lists(same_n, pa.int32()), _lists(other, pa.int64()), _lists(other_n, pa.int32())],
            names=["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "other", "other_n"])


def document_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document its sizes and its distinct linked pairs with how often each is linked: ``same`` are A ids linked to the B id with their
    bytes (exact one-to-one groups, and such pairs inside irregular groups), ``other`` all other pairs as A id * 2**32 + B id. Not yet computed."""
    paths = _paths(a_path, b_path)
    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda batches: _document_counts(batches, paths), COUNT_COLUMNS.format(id=f"doc_id {kind},"))


def same_id_counts(counts: DataFrame, size: int) -> DataFrame:
    """In how many documents each A id is linked to its twin: one vector of the vocabulary's length per task, added up."""
    def run(batches):
        vector = np.zeros(size, np.int64)
        for batch in batches:
            vector += np.bincount(batch.column("same").flatten().to_numpy(zero_copy_only=False), minlength=size)
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(vector[ids], pa.int64())], names=["a", "n"])

    return counts.select("same").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """In how many documents each irregular pair is linked."""
    return counts.select(F.explode("other").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _hot_from(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their count."""
    reach = pairs.agg(*[F.count_if(F.col("n") >= 1 << k).alias(f"k{k}") for k in range(63)]).first()
    return next(1 << k for k in range(63) if reach[k] <= most)


def _score(batches, shared, size):
    same_n, best, pairs, pair_n = (x.value for x in shared)
    for batch in batches:
        n = batch.num_rows
        out = np.zeros((2, n), np.int64)

        def add(name, ids, counts, a_ids):
            owner = np.repeat(np.arange(n), np.diff(batch.column(name).offsets.to_numpy()))
            times = batch.column(f"{name}_n").flatten().to_numpy(zero_copy_only=False)
            np.add.at(out[0], owner, times * (counts == best[a_ids]))
            np.add.at(out[1], owner, times * counts)

        ids = batch.column("same").flatten().to_numpy(zero_copy_only=False)
        add("same", ids, same_n[ids], ids)
        codes = batch.column("other").flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(pairs, codes), max(len(pairs) - 1, 0))
        found = pairs[at] == codes if len(pairs) else np.zeros(len(codes), bool)
        # a pair that is not among the broadcast ones counts nothing here and is handed on
        counts = np.where(found, pair_n[at], 0) if len(pairs) else np.zeros(len(codes), np.int64)
        add("other", codes, counts, codes >> 32)
        owner = np.repeat(np.arange(n), np.diff(batch.column("other").offsets.to_numpy()))
        rest = np.bincount(owner[~found], minlength=n)
        edges = pa.array(np.concatenate(([0], np.cumsum(rest))), pa.int32())
        times = batch.column("other_n").flatten().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), pa.array(out[0]), pa.array(out[1]),
             pa.ListArray.from_arrays(edges, pa.array(codes[~found], pa.int64())), pa.ListArray.from_arrays(edges, pa.array(times[~found], pa.int32()))],
            names=["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "rest_n"])


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are tokenized once; sizes, digests and distinct pairs are written. Pairs of ids with the same bytes are counted in vectors of the
    vocabulary's length and never shuffled one by one; all others are counted by a shuffle of pre-aggregated pairs. Back to the documents
    go, as broadcasts of bounded size, those vectors, the highest count of each A id, and the most frequent irregular pairs (at most ``hot_pairs``).
    A rarer pair occurs, by that choice, in few documents, so the join that brings its count has no hot key.

    Null or empty text, or one whose bytes a tokenizer changes: zeros and an empty digest. Repeated rows and equal or null doc_ids: every row is a
    document and counts by itself. Ties for the highest count: all of them are best. No rows: no rows. Columns other than doc_id and text are
    not read. A very long text is handled in arrays of its own length.
    """
    spark = docs.sparkSession
    a_path, b_path = _paths(a_path, b_path)
    size = aligner(a_path, b_path).a.size
    counts = stored(document_counts(docs, a_path, b_path), compression="zstd")
    same, pairs = stored(same_id_counts(counts, size)), stored(pair_counts(counts))
    best_of = (same.select("a", "n").unionByName(pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), "n"))
               .groupBy("a").agg(F.max("n").alias("n")))
    hot_from = _hot_from(pairs, hot_pairs)
    hot = pairs.filter(F.col("n") >= hot_from).toArrow().sort_by("pair")
    vectors = []
    for table in (same.toArrow(), best_of.toArrow()):  # at most one row per A id
        vector = np.zeros(size, np.int64)
        vector[table["a"].to_numpy()] = table["n"].to_numpy()
        vectors.append(vector)
    shared = [spark.sparkContext.broadcast(x) for x in (*vectors, hot["pair"].to_numpy(), hot["n"].to_numpy())]
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    scored = counts.mapInArrow(lambda batches: _score(batches, shared, size), f"row_id long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_n array<int>")
    if hot_from == 1:
        return scored.select(*result)
    scored = stored(scored, compression="zstd")
    rare = pairs.filter(F.col("n") < hot_from).join(best_of.withColumnRenamed("n", "best"), F.shiftright("pair", 32).cast("int") == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    rest = (scored.select("row_id", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("row_id", F.col("r.rest").alias("pair"), F.col("r.rest_n").alias("times"))
            .join(rare, "pair").groupBy("row_id")
            .agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("times") * F.col("n")).alias("rest_sum")))
    return (scored.join(rest, "row_id", "left")
            .withColumns({"n_best": F.col("n_best") + F.coalesce("rest_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))})
            .select(*result))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(read_table(spark, folder, "documents"))
