"""Decontamination, licence scan, quality outliers and mixing against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prematch.llm import decontaminate, license_scan, mixing, quality_outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(seed, n, words=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# -- decontamination

def test_decontaminate_brute_force(spark, make_docs):
    item, short = text_of(1, 30), "Only Four Words here"
    docs = [(1, "start " + item.upper() + " end"), (2, text_of(2, 400) + " " + " ".join(item.split()[3:18])), (3, None), (4, ""), (5, "x only, four-words HERE y"), (6, text_of(6, 50)),
            (6, text_of(6, 50)), (None, item), (7, text_of(7, 30_000) + " " + item), (8, "é " + item.replace(" ", "-"))]
    bench = spark.createDataFrame([(10, item), (9, item), (11, short), (12, None), (13, ""), (None, "lone words")], "item_id long, text string")
    got = decontaminate.contamination(make_docs(docs), bench).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in [(10, item), (9, item), (11, short), (None, "lone words")]:
        w = words(t)
        for k in range(max(len(w) - 12, 1)):
            windows.setdefault(tuple(w[k:k + 13]), set()).add(i)
    want = Counter()
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])] - {None}
        want[d, len(w), len(hit), tuple(sorted(map(str, items))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    have = Counter()
    for r in got:
        have[r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated] += r.n_rows
    assert have == want


def test_decontaminate_removes(spark, make_docs):
    item = text_of(1, 20)
    docs = make_docs([(1, "a, b: " + item + "! c d."), (2, "clean text"), (3, None)]).withColumn("spans", F.lit("x"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {1: "a, b: c d.", 2: "clean text", 3: None}
    assert decontaminate.remove_documents(docs, bench).columns == docs.columns
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontaminate_without_broadcast(spark, make_docs, monkeypatch):
    item = text_of(1, 20)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    assert [r.n_hit for r in decontaminate.contamination(make_docs([(1, "a " + item)]), bench).collect()] == [20]


# -- licences

def test_license_scan(spark, make_docs):
    rows = [(i, f"{text_of(i, 40)} {text} {text_of(i + 99, 40)}") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, None), (101, ""), (102, "mit"), (103, "Released  under\nthe MIT license"), (103, "Released  under\nthe MIT license"), (None, "Licensed under CC BY-NC 4.0."), (104, text_of(5, 20_000))]
    got = license_scan.licenses(make_docs(rows).withColumn("n_licenses", F.lit("clash")).withColumn("key", F.lit(1)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "license_ids", "n_licenses"]

    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
    want = Counter((d, ",".join(sorted(i for i, t in license_scan.TEMPLATES if len(grams(t) & grams(text)) >= 0.8 * len(grams(t))))) for d, text in rows)
    assert Counter((r.doc_id, r.license_ids) for r in got.collect()) == want
    assert license_scan.licenses(make_docs(rows).limit(0)).count() == 0


# -- quality

def brute_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics(spark, make_docs):
    line = text_of(3, 12)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, f"{line}\n{line}\n\n{line}\nx"), (6, "é𝄞 ## " * 30), (7, "a " * 500), (8, text_of(8, 20_000, 9)), (9, f"{line} {line[4:]}"), (9, f"{line} {line[4:]}"), (None, "n b\x0bq\rz")]
    got = quality_outliers.base_statistics(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *brute_statistics(t)) for d, t in rows)


def brute_distance(x):
    """The same estimate by numpy: median and deviation, then steps on the nearest three quarters, cut at whole distance bins."""
    floor = np.array(quality_outliers.FLOORS) * quality_outliers.UNIT
    low = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]
    centre = np.array([low(c) for c in x.T], float)
    scale = np.maximum([1.4826 * low(np.abs(c - m)) for c, m in zip(x.T, centre, strict=True)], floor)
    inverse = np.diag(1 / scale**2)
    for step in range(quality_outliers.STEPS + 1):
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        if step == quality_outliers.STEPS:
            return d2
        bins = np.floor(quality_outliers.BINS * np.log1p(d2))
        cut = np.sort(bins)[math.ceil(quality_outliers.KEEP_SHARE * len(bins)) - 1]
        near = x[bins <= cut]
        centre = near.mean(axis=0)
        inverse = np.linalg.inv(quality_outliers.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(floor**2))


def test_quality_outliers(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, text_of(i, rng.randint(60, 400), 5000), "en" if i % 3 else None, "a" if i % 2 else None) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in text_of(i, 200, 5000).split()), "en", "a") for i in range(4)]
    rows += [(2000, text_of(1, 100), "xx", "small"), (2001, None, "en", "a"), (2002, "", None, None)]
    docs = make_docs(rows).withColumn("x0", F.lit("clash")).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality_outliers.judge(docs).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + i].kept for i in range(4))
    assert all(got[i].kept for i in range(400)) and got[2000].kept and got[2000].d2 is None
    assert not got[2001].kept and not got[2002].kept
    members = [r for r in got.values() if r.lang == "en" and r.source == "a" and not r.base_failed]
    text = {r[0]: r[1] for r in rows}
    vec = []
    for r in members:
        n, chars, sym, dup, rep = brute_statistics(text[r.doc_id])
        lines = len([x for x in text[r.doc_id].split("\n") if WORD.search(x)])
        vec.append([round(v * quality_outliers.UNIT) for v in (math.log1p(n), math.log1p(chars / n), math.sqrt(sym / n), math.sqrt(dup / lines), math.sqrt(rep / n))])
    np.testing.assert_allclose([r.d2 for r in members], brute_distance(np.array(vec, float)), rtol=1e-5, atol=1e-6)
    assert quality_outliers.judge(docs.limit(0)).count() == 0


def test_quality_repeats_alone(spark, make_docs):
    """In a group without repeats, 50 to 70 % repeated lines or 25 % repeated words are enough by themselves; a table is not."""
    rng = random.Random(5)
    line = lambda i: text_of(i, 6, 5000)
    rows = [(i, "\n".join(line(40 * i + k) for k in range(rng.randint(20, 40))), "en", "a") for i in range(200)]
    for n, share in enumerate((0.5, 0.6, 0.7)):  # lines of under 8 words each between others, so that no 8-word window repeats
        lines = [line(90_000 + 100 * n + k) if k >= share * 30 else "w1 w2" for k in range(31)]
        rng.shuffle(lines)
        rows.append((1000 + n, "\n".join(lines), "en", "a"))
    part = text_of(77_000, 20, 5000)
    rows.append((1100, f"{text_of(77_001, 60, 5000)} {part} {text_of(77_002, 60, 5000)} {part}", "en", "a"))
    rows += [(1200 + n, "\n".join(" ".join(f"{w} |" if k % 2 else w for k, w in enumerate(line(95_000 + 50 * n + k).split())) for k in range(30)), "en", "a") for n in range(4)]
    got = {r.doc_id: r for r in quality_outliers.judge(make_docs(rows)).collect()}
    assert not any(got[d].base_failed for d in got if d != 1002)
    assert not any(got[d].kept for d in (1000, 1001, 1002, 1100))
    assert all(got[1200 + n].kept for n in range(4)) and sum(got[i].kept for i in range(200)) >= 198


# -- mixing

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, text_of(i, rng.choice([0, 5, 30, 30, 30, 200])), "en", rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])) for i in range(600)]
    rows += [(7000, None, "en", "b"), (None, "a b c", "en", "c"), (7001, text_of(1, 30_000), "en", "a"), (5, "twice", "en", "d"), (5, "twice", "en", "d"), (7002, "", "en", "empty")]
    docs = make_docs(rows).withColumn("size", F.lit("clash")).withColumn("mix_n", F.lit(1))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5, "lang")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    want = brute_targets({s: sizes[s] for s in {x[3] for x in rows}})
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    mixed = mixing.mix_documents(docs)
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == [*docs.columns, "copy"]
    assert mixing.mix(docs.limit(0)).count() == 0


