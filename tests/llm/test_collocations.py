import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prematch.llm import collocations as co
from prematch.llm.hat_trie import HatTrie, combined


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=60), max_size=12), st.integers(5, 60), st.integers(2, 20))
def test_trie_counts_and_spills(batches, max_entries, burst):
    trie, got, want, high = HatTrie(2, max_entries, burst), Counter(), Counter(), np.uint64(1 << 60)

    def take(run):
        keys = [tuple(k) for k in run[0].T.tolist()]
        assert keys == sorted(set(keys)) and (run[1] > 0).all()
        for key, n in zip(keys, run[1].tolist()):
            got[key] += n

    for rows in batches:
        keys = np.array(rows, np.uint64).reshape(-1, 2).T * high + np.uint64(1)
        want.update(tuple(k) for k in keys.T.tolist())
        for run in trie.add(keys):
            take(run)
        assert sum(map(trie._entries, trie.root)) <= max(max_entries, 0)
    for run in trie.drain():
        take(run)
    assert got == want


def test_keys_that_share_a_hash_stay_apart():
    keys, hashes, counts = combined(np.array([[3, 1, 3, 2, 1]], np.uint64), np.zeros(5, np.uint64), np.ones(5, np.int64))
    assert dict(zip(keys[0].tolist(), counts.tolist())) == {1: 2, 2: 1, 3: 2}


def plain(docs, least, longest=4, top=2000, covered=80):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] = counts.get((lang, tuple(words[i:i + k])), 0) + 1
    out = []
    for lang in totals:
        own = {p: n for (x, p), n in counts.items() if x == lang}
        cands = {p: n for p, n in own.items() if len(p) >= 2 and n >= least}
        scored = []
        for p, a in cands.items():
            longer = [m for q, m in cands.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * m >= covered * a for m in longer):
                continue
            score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def mined(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["new", "york", "City", "été", "a", "b", "c", "d-e", "x\x00y", " z"]
    docs = [(None, None, "en"), (1, "", None), (2, " ,.;\n", "en"), (3, "und phrase und phrase", None), (3, "und phrase und phrase", "und")]
    for i in range(n):
        parts = [words[j] for j in rng.integers(0, len(words), rng.integers(1, 30))] + (["New", "York"] * int(rng.integers(0, 3)))
        docs.append((i, "".join(w + str(rng.choice([" ", "  ", "\t", " ", " ", ", ", "\n", "! "])) for w in parts), ["en", "fr", None][i % 3]))
    return docs


@pytest.mark.parametrize("settings_", [{}, {"max_entries": 40}, {"hot_prefix": 0.0}, {"longest": 2}, {"longest": 3, "top": 5}])
def test_against_loops(spark, make_docs, settings_):
    from pyspark.sql import functions as F
    docs = corpus(5)
    frame = make_docs(docs).repartition(4).withColumn("w1", F.lit("user's")).withColumn("n", F.lit("user's"))
    kept = {k: v for k, v in settings_.items() if k in ("longest", "top")}
    assert mined(co.collocations(frame, least=4, **settings_)) == plain(docs, 4, **kept)


def test_no_rows_and_nothing_frequent(spark, make_docs):
    assert co.collocations(make_docs([(1, "one two")]).limit(0)).count() == 0
    assert co.collocations(make_docs([(1, "one two three four five"), (2, None)])).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    text = b"alpha beta gamma, delta epsilon. " * 50 + b"no end of a piece " * 30
    whole = co._ids(text, np.uint64(7))
    for size in (1, 10, 300, 10_000):
        monkeypatch.setattr(co, "CHUNK", size)
        parts = list(co._chunks([text, b"", b"last"]))
        ids = np.concatenate([co._ids(p, np.uint64(7)) for p in parts])
        assert ids[:-1].tolist() == whole.tolist()
        batch = pa.RecordBatch.from_pydict({"text": [text.decode()] * 3, "lang": ["en"] * 3})
        open_filter = SimpleNamespace(value=np.full(8192, 255, np.uint8))
        runs = Counter()
        for run in co._phrase_runs([batch], 0, [3, 4], 500, open_filter, np.zeros(0, np.uint64)):
            for row in run.to_pylist():
                runs[row["w1"], row["w2"], row["w3"], row["w4"]] += row["n"]
        if size == 1:
            first = runs
        assert runs == first


def test_shared_ids_take_another_seed(spark, make_docs, monkeypatch):
    tried = []
    real = co._word_runs

    def clash(batches, seed, max_entries):
        for run in real(batches, seed, max_entries):
            yield run if seed else run.set_column(0, "w1", pa.array([5] * run.num_rows, pa.int64()))

    monkeypatch.setattr(co, "_word_runs", clash)
    words, seed = co._words(make_docs([(1, "one two two")]).select("text", "lang"), 100)
    assert seed == 1 and {(r.lang, r.word, r.n) for r in words.collect()} == {("en", "one", 1), ("en", "two", 2)}
