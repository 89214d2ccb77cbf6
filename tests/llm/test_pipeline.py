"""The five stages in a row on planted documents, against what each rule says by itself."""

import random

import corpus_pipeline
from prematch.llm import secret_scan

EN = "the house near river where people walk every morning with their children before going home again because weather was good and they like long quiet ways through green fields".split()
DE = "das haus am fluss wo leute jeden morgen mit ihren kindern gehen bevor sie wieder nach hause kommen weil wetter gut war und lange ruhige wege durch gruene felder ihnen gefallen".split()


def words(rng, vocabulary, n=80):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def planted():
    rng = random.Random(7)
    docs = {i: (words(rng, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(60)}
    item = words(rng, EN, 20)
    copy = docs[7][0].split()
    copy[40] = "changed"
    docs |= {100: ("12345 67890 !!! 42", None), 101: docs[5], 102: (" ".join(copy), "en"), 103: (f"{words(rng, EN, 8)} {item} {words(rng, EN, 8)}", "en"),
             104: (f"{words(rng, EN, 30)} password = abcdefgh12345678 {words(rng, EN, 30)}", "en"), 105: (None, "en"), 106: ("", "de")}
    assert 0.8 <= len(shingles(docs[7][0]) & shingles(docs[102][0])) / len(shingles(docs[7][0]) | shingles(docs[102][0])) < 1
    return docs, item


def test_stages_in_a_row(spark, tmp_path):
    docs, item = planted()
    rows = [(i, t, lang, "web", len(t or "")) for i, (t, lang) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b1", item), ("b2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert kept & {100, 103, 105, 106} == set()                           # no letters, contaminated, no text
    assert len(kept & {5, 101}) == 1 and len(kept & {7, 102}) == 1        # one of each group of copies
    assert set(range(60)) - {5, 7} <= kept and 104 in kept                # clean documents stay
    for r in out:
        if r.doc_id == 104:
            assert "abcdefgh12345678" not in r.text and secret_scan.MASK in r.text and r.n_chars == len(r.text)
        else:
            assert (r.text, r.lang, r.source) == (*docs[r.doc_id], "web")
    copies = {i: sorted(r.copy for r in out if r.doc_id == i) for i in kept}
    assert all(c == list(range(1, len(c) + 1)) and len(c) <= 2 for c in copies.values())
    sizes = {r.doc_id: len(r.text.split()) for r in out}
    taken, target = sum(sizes[i] * len(c) for i, c in copies.items()), 1.5 * sum(sizes.values())
    assert abs(taken - target) <= max(sizes.values())                      # the one source's share of the mix


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", "some text of an item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_keeps_the_columns(spark, tmp_path):
    docs, item = planted()
    frame = spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, (t, lang) in docs.items() if i < 12], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mix_sources"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns
