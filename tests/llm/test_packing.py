import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prematch.llm import grouped_packing, packing
from prematch.llm.vocabularies import byte_level, public_path

PATH = public_path("byte_bpe_50k.json")


def counted(bins):
    got = Counter()
    for b in bins:
        for length, each in b.content:
            got[length] += each * b.times
    return got


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.integers(2, 12))
def test_histogram_is_packed_whole(counts, groups):
    bins = grouped_packing.pack_lengths(counts, 64, groups)
    assert counted(bins) == Counter(counts)
    assert all(sum(a * n for a, n in b.content) <= 64 and b.times > 0 for b in bins)


@pytest.mark.parametrize("counts, best", [
    ({683: 100, 682: 50, 1: 3}, 51), ({1025: 1000, 1023: 999, 3: 5}, 1000), ({2048: 7, 1: 2048}, 8), ({600: 300, 1400: 300, 48: 300}, 300),
    ({513: 4, 511: 4}, 2), ({}, 0),
])
def test_known_optima(counts, best):
    assert sum(b.times for b in grouped_packing.pack_lengths(counts, 2048)) == best


def test_few_sequences_on_many_lengths():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(300, 700, 30_000), rng.integers(1, 2049, 200_000), np.minimum(2047, rng.lognormal(6, 1, 100_000).astype(int) + 1)):
        counts = Counter(lengths.tolist())
        used = sum(b.times for b in grouped_packing.pack_lengths(counts, 2048))
        assert used <= 1.01 * -(-int(lengths.sum()) // 2048) + 1


def test_configurations_reach_the_fractional_optimum():
    sizes, demand = np.array([44, 41, 33, 28, 17]), np.array([40.0, 30, 60, 50, 80])
    found = grouped_packing.configurations(sizes, demand, 100)
    assert all(often >= 0 and column @ sizes <= 100 for column, often in found)
    np.testing.assert_allclose(sum(column * often for column, often in found), demand, atol=1e-6)
    prices = np.linalg.solve(np.array([c for c, _ in found], float), np.ones(5))
    every = [c for c in np.ndindex(3, 3, 4, 4, 6) if np.array(c) @ sizes <= 100]
    assert max(prices @ np.array(c) for c in every) <= 1 + 1e-6  # no configuration has a reduced cost below 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", " \n\n x", "\x00", "don't  stop"]))
def test_ids_equal_those_of_the_library(text):
    library = Tokenizer.from_file(PATH)
    assert byte_level(PATH, False).encode(text) == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    assert byte_level(PATH, True).encode(text) == library.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity):
    library = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        start = 0
        for k in range(-(-len(ids) // capacity)):
            stop = len(ids) - capacity * (-(-len(ids) // capacity) - 1 - k)
            expected[doc_id, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(bytes(r.tokens))) for r in rows) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [p[0] for p in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by_sequence)


def test_pack_against_plain_cutting(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "word " * 500), (3, "word " * 500), (None, "no id"), (5, "x" * 20_000), (6, "<|endoftext|>")] + [(10 + i, "same length") for i in range(300)]
    frame = make_docs(docs).repartition(5).withColumn("tokens", frame_column()).withColumn("task", frame_column())
    rows = packing.pack(frame, capacity=128, groups=6).collect()
    used = check(rows, docs, 128)
    assert used <= -(-sum(r.length for r in rows) // 128) + 2
    assert packing.pack(frame.limit(0)).count() == 0


def frame_column():
    from pyspark.sql import functions as F
    return F.lit("user's")


def test_sequences_hold_their_pieces(spark, make_docs):
    packed = packing.pack(make_docs([(i, f"text number {i} " * (i % 7)) for i in range(60)]), capacity=64)
    rows = packed.collect()
    whole = {r.sequence_id: bytes(r.tokens) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.tokens)
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)


def test_string_ids(spark):
    docs = [("a", "x y z"), ("b", None)]
    check(packing.pack(spark.createDataFrame(docs, "doc_id string, text string")).collect(), docs, 2048)


def test_registered_query_on_documents(spark):
    from prematch.llm.common import read_table
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in read_table(spark, folder, "documents").collect()]
    rows = packing.op11_best_fit_packing(spark, folder).collect()
    library = Tokenizer.from_file(PATH)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.005 * sum(map(len, ids.values())) / 2048 + 1
