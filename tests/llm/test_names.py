"""Columns of the user's that carry the names of helpers come through unchanged."""

from pyspark.sql import functions as F

from prematch.llm import html_extract, language_id, quality_outliers, secret_scan


def named(docs, *names):
    return docs.withColumns({n: F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")) for n in names})


def unchanged(rows, *names):
    return all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)


def test_quality_columns(spark, make_docs):
    names = ["y2020", "m1", "l", "x9", "q_lang", "near", "user_columns", "a b", "bin"]
    docs = make_docs([(i, f"some words of a text number {i} " * 4) for i in range(80)])
    plain = {r.doc_id: (r.kept, r.d2) for r in quality_outliers.judge(docs).collect()}
    rows = quality_outliers.judge(named(docs, *names)).collect()
    assert len(rows) == 80 and unchanged(rows, *names) and {r.doc_id: (r.kept, r.d2) for r in rows} == plain


def test_redacted_columns(spark, make_docs):
    docs = make_docs([(1, "password = abcdefgh12345678 in a text"), (2, "nothing here"), (3, None)])
    rows = secret_scan.redact(named(docs, "masked", "sec_", "MASKED_")).collect()
    assert len(rows) == 3 and unchanged(rows, "masked", "sec_", "MASKED_")
    assert {r.doc_id: r.text for r in rows}[2] == "nothing here" and "abcdefgh" not in {r.doc_id: r.text for r in rows}[1]


def test_language_and_page_columns(spark, make_docs):
    model = language_id.fit(make_docs([(i, t * 5, lang) for i, (t, lang) in enumerate([("the house is near the road ", "en"), ("das haus ist an der strasse ", "de")] * 30)]))
    rows = language_id.identify(named(make_docs([(1, "the house"), (2, None)]), "judged", "lid_"), model).collect()
    assert len(rows) == 2 and unchanged(rows, "judged", "lid_")
    pages = named(spark.createDataFrame([(1, "<p>text of a page</p>"), (2, None)], "doc_id long, html string"), "main_text", "hx_")
    rows = html_extract.extract(pages, None).collect()
    assert unchanged(rows, "main_text", "hx_") and {r.doc_id: r.text for r in rows} == {1: "text of a page", 2: ""}
