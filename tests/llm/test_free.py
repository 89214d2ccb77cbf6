"""Url graph, language, pages, passages, near-duplicates and secrets against plain Python, closed forms or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prematch.llm import fm_index, html_extract, language_id, near_dedup, secret_scan, substring_dedup, url_graph
from prematch.llm.components import components
from prematch.llm.html_dom import Dom


def text_of(seed, n, words=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# -- urls

def test_url_rules(spark):
    urls = ["http://a.net/x", "https://B.Example.NET/en/1?q", "http://example.net/en", "http://x.example.com/de/", "http://x.example.com/de", "http://w.org/fr/a#b", "http://w.org/fra", "ftp://net", None, "", "no scheme", "http://", "http://h?x://y/", "http://notnet/x", "http://a.net?/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_graph.judge(pages).collect()}

    def want(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [h + p for h, p, _ in url_graph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)
    assert got == {i: want(u) for i, u in enumerate(urls)}


def test_url_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/", ""), (2, "http://farm.test/", link("bad.net")), (3, "http://both.test/", link("bad.net", "fine.test")), (4, "http://fine.test/", link("fine.test")), (5, "http://good.org/fr/", link("fine.test", "farm2.test")),
            (6, "http://farm2.test/", link("bad.net", "bad.net")), (6, "http://farm2.test/", link("bad.net", "bad.net")), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_graph.judge(pages).collect()}
    hosts = ["bad.net", "farm.test", "both.test", "fine.test", "good.org", "farm2.test"]
    links = np.zeros((6, 6))
    for a, b in (("farm.test", "bad.net"), ("both.test", "bad.net"), ("both.test", "fine.test"), ("good.org", "fine.test"), ("good.org", "farm2.test"), ("farm2.test", "bad.net")):
        links[hosts.index(a), hosts.index(b)] = 1
    share = links / np.maximum(links.sum(axis=1, keepdims=True), 1)
    trust, distrust = np.eye(6)[4], np.eye(6)[0]
    wave_t, wave_d = trust.copy(), distrust.copy()
    back = (links / np.maximum(links.sum(axis=1, keepdims=True), 1)).T
    for _ in range(url_graph.ROUNDS):
        wave_t, wave_d = 0.5 * wave_t @ share, 0.5 * wave_d @ back
        trust, distrust = trust + wave_t, distrust + wave_d
    for i, h in enumerate(hosts):
        assert got[h].trust == pytest.approx(trust[i]) and got[h].distrust == pytest.approx(distrust[i])
    assert got["farm.test"].verdict == "block" and got["fine.test"].verdict == got["both.test"].verdict == "allow" and got[""].verdict == "allow"
    assert url_graph.judge(pages.limit(0)).count() == 0


def test_url_mostly_bad_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    bad, fine = [f"b{i}.net" for i in range(10)], [f"f{i}.test" for i in range(10)]
    rows = [f"http://{h}/" for h in bad]
    pages = [(0, u, "") for u in rows] + [(n, f"http://h{n}.test/", link(*bad[:n], *fine[n:])) for n in range(11)] + [(20, "http://sub.tied.test/", link(*bad))]
    got = {r.host: r.verdict for r in url_graph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {n for n in range(11) if got[f"h{n}.test"] == "block"} == {6, 7, 8, 9, 10}
    assert got["sub.tied.test"] == "block"


# -- languages

SYLLABLES = {"en": "th the er on an re ing ed wh sh", "de": "sch en ung keit ch ei ver ge ber ü", "fr": "eau ou ai é è tion que aux oi ç", "es": "ción ado os as ñ que rr ll mente ía"}


def words_in(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_held_out(spark, make_docs):
    rows = [(i, words_in(lang, i, 40), lang) for i in range(400) for lang in [list(SYLLABLES)[i % 7 % 4]]]
    docs = make_docs([*rows, (900, words_in("fr", 1, 50), None)])
    model = language_id.fit(docs)
    assert model["families"] == ["germanic", "romance"] and set(model["pairs"]) == {("de", "en"), ("es", "fr")}
    odd = [(1000, None), (1001, ""), (1002, "12 -- ###"), (None, words_in("de", 5, 30)), (1003, words_in("es", 6, 40_000)), (1003, words_in("es", 6, 40_000))]
    got = language_id.identify(make_docs([*rows, *odd]).withColumn("lang_pred", F.lit("clash")), model).withColumn("held_out", language_id.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 50 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "de", "es"] and by[1000].score == 0 and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(make_docs([*rows, *odd]), model)
    assert kept.count() == len(rows) + 3 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_without_labels(spark, make_docs):
    docs = make_docs([(1, "some text", None), (2, "more", None)])
    assert language_id.fit(docs) is None and language_id.fit(docs.limit(0)) is None
    assert [r.lang_pred for r in language_id.identify(docs, None).collect()] == ["und", "und"]


def test_language_never_sees_held_out_rows(spark, make_docs):
    rows = [(i, words_in("en" if i % 2 else "fr", i, 20), "en" if i % 2 else "fr") for i in range(200)]
    import zlib
    wrong = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else k) for d, t, k in rows]
    assert set(language_id.sample_features(make_docs(wrong))["lang"]) == {"en", "fr"}


# -- pages

def page(article, before="", after="", inside="", tag="article"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Two</a></li></ul></nav>{before}<{tag}><h1>Head &amp; more</h1>{''.join(f'<p>{p}</p>' for p in article)}{inside}</{tag.split()[0]}>{after}<footer>&copy; us</footer></body></html>"


def test_dom_blocks():
    dom = Dom("<p>one <b>bold</b>\n two<br>three<p>four &lt;x&gt;<ul><li>a<li>b</ul><script>x<y</script><!-- c --><div>five<img>six</div>tail <p unfinished")
    assert [t for _, t in dom.blocks] == ["one bold two", "three", "four <x>", "a", "b", "five", "six", "tail"] or [t for _, t in dom.blocks][:5] == ["one bold two", "three", "four <x>", "a", "b"]
    assert Dom("").blocks == [] and Dom("<").blocks == [(0, "<")] and Dom("<!-- open").blocks == []


def test_html_extraction(spark):
    rows = []
    for i in range(160):
        paragraphs = [text_of(i * 10 + k, 3 + (i * k) % 60) for k in range(1 + i % 6)]
        rows.append((i, page(paragraphs), "\n".join(["Head & more", *paragraphs])))
    odd = [(200, None, ""), (201, "", ""), (202, page(["long " * 60_000]), "Head & more\n" + "long " * 59_999 + "long"), (203, page(["a"], after="<div class='comments'><p>reader said this</p></div>"), "Head & more\na"),
           (204, page(["b c", "d"], before="<div class='cookie-notice'>We use cookies</div>", tag="div class='entry-content'"), "Head & more\nb c\nd"), (205, page([text_of(5, 50)], inside="<form><p>Sign up</p><input></form>"), "Head & more\n" + text_of(5, 50)),
           (205, page([text_of(5, 50)], inside="<form><p>Sign up</p><input></form>"), "Head & more\n" + text_of(5, 50)), (206, page(["x"], after="<aside><p>side words</p></aside>"), "Head & more\nx")]
    pages = spark.createDataFrame([(i, h, "clash") for i, h, _ in rows + odd], "page_id long, html string, text string")
    model = html_extract.fit(pages)
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages, model).collect())
    want = Counter((i, t, len(t)) for i, _, t in rows + odd)
    wrong = [(k[0], k[1][:80]) for k in (got - want)]
    assert not wrong
    assert html_extract.fit(pages.limit(0)) is None and html_extract.extract(pages.limit(0), None).count() == 0


def test_decisions_are_consistent():
    dom = Dom("<div><p>a</p><section><p>b</p><p>c</p></section></div>")
    keep = html_extract.decide(dom, np.array([0, 3, 2, -5, 1, 1.0]))
    assert keep.tolist() == [True, True, True, False, False, False]
    assert html_extract.decide(dom, np.array([0, -1, 2, -1, 4, 4.0])).all()  # strong descendants carry weak ancestors


# -- passages

def brute_passages(rows, window=20):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (d, i)) != (d, i):
                gone[i:i + window] = [True] * window
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [400_000, 400, 20])
def test_substring_dedup(spark, make_docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    shared = [text_of(900 + k, 25 + k) for k in range(6)]
    rng = random.Random(2)
    rows = [(i, " ".join(x for k in range(4) for x in (text_of(i * 7 + k, rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 20):]))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a b " * 40), (105, "one two three four five " * 5), (106, text_of(1, 20_000, 3)), (107, rows[5][1] + "\u00a0x\x0by"), (None, rows[4][1])]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.kept_words(make_docs(rows)).collect()}
    want = brute_passages(rows)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert got == want


def test_substring_dedup_repeated_rows(spark, make_docs):
    docs = make_docs([(1, text_of(1, 40)), (1, text_of(1, 40)), (2, text_of(1, 40))])
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.kept_words(docs).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert substring_dedup.kept_words(docs.limit(0)).count() == 0


def test_substring_dedup_string_ids_and_one_long_run(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", 1000)
    passage, again = text_of(1, 60), "same " * 30_000
    docs = spark.createDataFrame([("b", passage), ("a10", passage + " end"), ("a9", again), ("c", again + passage), (None, passage), ("d", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.kept_words(docs).collect()}
    assert got == {"a10": (61, 0), "b": (60, 60), "a9": (30_000, 29_999), "c": (30_060, 30_060), None: (60, 60), "d": (0, 0)}


def test_key_filter_lets_all_its_keys_through(spark):
    from prematch.llm.key_filter import key_filter, passes
    from prematch.llm.word_hashes import mix
    for n in (0, 1, 5000):
        keys = mix(np.arange(n, dtype=np.uint64))
        bits = key_filter(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long"), "k", n).value
        assert passes(bits, keys).all()
        assert passes(bits, mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))).mean() < 0.1


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 600)
    index = fm_index.FmIndex(text, 4)
    for pattern in [rng.integers(1, 6, 4) for _ in range(60)]:
        low, high = np.array([0]), np.array([len(text)])
        for number in pattern[::-1]:
            low, high = index.extend(np.array([number if number <= index.top else 0]), low, high) if number <= index.top else (low, low)
        want = [i for i in range(len(text) - 3) if (text[i:i + 4] == pattern).all()]
        assert high[0] - low[0] == len(want)
        assert sorted(index.order[low[0]:high[0]].tolist()) == want


# -- near-duplicates

def brute_classes(rows, similar=0.8):
    grams = {}
    for d, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        grams[d] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {d: d for d in grams}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = list(grams)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if grams[a] and grams[b] and len(grams[a] & grams[b]) >= similar * len(grams[a] | grams[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in ids}


def edited(text, at):
    w = text.split()
    for k in at:
        w[k % len(w)] = f"new{k}"
    return " ".join(w)


@pytest.mark.parametrize("few", [64, 2])
def test_near_dedup(spark, make_docs, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    base = [text_of(i, 200, 5000) for i in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + i, edited(base[i % 5], [7 * i])) for i in range(40)]         # near copies
    rows += [(200 + i, base[6]) for i in range(10)] + [(300, base[7].upper().replace(" ", ", "))]
    rows += [(400 + i, edited(base[8], range(5, 200, 6 - i % 3))) for i in range(6)]  # too far
    rows += [(500, None), (501, ""), (502, " .. "), (503, "short one"), (504, "short one"), (505, text_of(1, 15_000, 5000)), (506, text_of(1, 15_000, 5000) + " x")]
    docs = make_docs(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    want = brute_classes(rows)
    assert got == want
    kept = near_dedup.keep_one(docs.withColumn("label", F.lit("clash")).withColumn("key", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns[-2:] == ["label", "key"]


def test_profiles_bound_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(1, 1 << 63, 900, dtype=np.uint64))
    for k in range(40):
        parts = [np.flatnonzero(rng.random(len(a)) < rng.uniform(0.3, 1)) for _ in range(2)]
        pair = [(a[p], (rng.uniform(0.5, 2, len(p)) * 10.0 ** (k % 8)).astype(np.float32)) for p in parts]
        (one, other), total = [np.frombuffer(near_dedup.profile(*x), np.float16).astype(np.float32) for x in pair], [float(w.sum(dtype=np.float64)) for _, w in pair]
        bound = near_dedup.bounds(one, total[0], other[None, :], np.array(total[1:]))[0]
        assert near_dedup.similarity(*pair) - 1e-5 <= bound <= 1


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup_single_band_of_a_large_group(spark, make_docs, monkeypatch, block):
    """Two copies of each other in a large band that no centre joins, and that share no second band."""
    monkeypatch.setattr(near_dedup, "FEW", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", block, raising=False)
    copy = text_of(50, 120, 5000)
    rows = [(i, text_of(i, 120, 5000)) for i in range(12)] + [(100, copy), (101, edited(copy, [60]))]

    def signed(docs, idf):  # all meet in band 0; the first twelve in every band, the two copies in no other
        out = [(d, hashlib.md5(t.encode()).hexdigest(), [0, *(k + 1000 * (d if d >= 100 else 0) for k in range(1, near_dedup.BANDS))]) for d, t in rows]
        return docs.sparkSession.createDataFrame([(d, f"{d}:{h}", h, keys) for d, h, keys in out], "doc_id long, row_key string, node string, keys array<long>")

    monkeypatch.setattr(near_dedup, "signatures", signed)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(rows)).collect()}
    assert got == {i: i for i in range(12)} | {100: 100, 101: 100}


def test_near_dedup_odd_rows(spark, make_docs):
    docs = make_docs([(1, "same words here again now"), (1, "same words here again now"), (None, "same words here again now"), (None, None), (2, "other")])
    assert near_dedup.keep_one(docs).filter("doc_id = 1").count() == 1
    assert sorted(map(str, [r.doc_id for r in near_dedup.keep_one(docs).collect()])) == ["1", "2", "None"]
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_samples_agree_by_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(1, 1 << 63, 400, dtype=np.uint64))
    agree, want = [], []
    for k in range(60):
        cut = rng.random(len(a)) < 0.8
        wa, wb = rng.uniform(0.5, 2, len(a)).astype(np.float32), None
        wb = np.where(rng.random(len(a)) < 0.5, wa, wa * 1.3).astype(np.float32)
        a2 = near_dedup.mix(a + np.uint64(k))
        agree.append((near_dedup.samples(a2, wa) == near_dedup.samples(a2[cut], wb[cut])).mean())
        order, other = np.argsort(a2), np.argsort(a2[cut])
        want.append(near_dedup.similarity((a2[order], wa[order]), (a2[cut][other], wb[cut][other])))
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_components(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)] + [("hub", f"s{i:03}") for i in range(200)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    up = defaultdict(lambda: None)

    def top(x):
        while up[x] not in (None, x):
            x = up[x]
        return x
    for a, b in pairs:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}


# -- secrets

def brute_secrets(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(spans)]


def secret_rows(n):
    rng = random.Random(6)
    word = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    rows = []
    for i in range(n):
        key = word("0123456789abcdef", 40)
        extra = [f'token = "{key}"', f"AKIA{word('ABCDEFGHIJ0123456789', 16)}", f"mail.{i}.user@host{i}.example.com2", f"call 555{word('0123456789', 9)} now", f"price1234567890usd{i}"][i % 5]
        rows.append((i, f"{text_of(i, 30)} {extra} {text_of(i + 1, 30)}"))
    return rows


def test_secret_patterns(spark, make_docs):
    texts = ["", "PassWord: 'abcdefghijkl' API_KEY=\"x.y-z/0123456789\"", "token=short token = abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIAshort", "x" + "0123456789abcdef" * 3 + "é", "secret:secret=secret:abcdefghijklmnop", "tſecret: abcdefghijklmnop to\u212aen=abcdefghijkl1",
             "apikey\n=abcdefghijklmnop", "é𝄞 token:   \"0123456789abcdef01", "password='a'password=abcdefghijkl12"]
    for t in texts:
        assert secret_scan.base_spans(t) == brute_secrets(t)


def test_secret_scan(spark, make_docs):
    rows = secret_rows(300)
    hidden = [(1000 + i, f"{text_of(i, 20)} token -> \"{hashlib.sha1(str(i).encode()).hexdigest().upper()}\" {text_of(i, 20)}") for i in range(20)]
    odd = [(2000, None), (2001, ""), (2002, "AKIA" + "Q1" * 9 + " x" * 60_000), (2002, "AKIA" + "Q1" * 9 + " x" * 60_000), (None, 'token = "abcdefabcdefabcdef01"')]
    docs = make_docs(rows + hidden + odd)
    found = secret_scan.findings(docs)
    model = secret_scan.fit(found)
    got = secret_scan.scan(found, model).collect()
    assert len(got) == len(rows + hidden + odd)
    text = {d: t for d, t in rows + hidden + odd}
    assert all([tuple(s) for s in r.base] == brute_secrets(text[r.doc_id] or "") for r in got)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) and [s.start for s in r.spans] == sorted(s.start for s in r.spans) for r in got)
    extra = {r.doc_id: len(r.spans) - len(r.base) for r in got}
    clean = [i for i in range(300) if i % 5 >= 2]
    assert sum(extra[i] for i in clean) <= 0.05 * len(clean)
    out = secret_scan.redact(docs.withColumn("spans", F.lit("clash")))
    by = {r.doc_id: r for r in out.collect()}
    assert out.columns[-1] == "spans" and by[2000].text is None and "AKIA" not in by[2002].text and by[None].text == "[secret]\"" and by[None].n_chars == 9
    assert sum(by[i].text == text[i] for i in clean) >= 0.95 * len(clean)


def test_secret_scan_without_findings(spark, make_docs):
    docs = make_docs([(1, "nothing here"), (2, None)])
    found = secret_scan.findings(docs)
    assert secret_scan.fit(found) is None and [len(r.spans) for r in secret_scan.scan(found, None).collect()] == [0, 0]
    assert secret_scan.redact(docs.limit(0)).count() == 0 and secret_scan.redact(docs).filter("doc_id = 1").first().text == "nothing here"


def test_network_learns():
    rows = secret_rows(900)
    seen, labels = [], []
    for _, t in rows:
        for _, _, label, window in secret_scan.candidates(t, secret_scan.base_spans(t)):
            seen.append(window)
            labels.append(label)
    model = secret_scan.learn(seen[:700], np.array(labels[:700]))
    p, y = secret_scan.probabilities(model, seen[700:]), np.array(labels[700:])
    assert ((p >= model["threshold"]) & y).sum() >= 0.85 * y.sum() and ((p >= model["threshold"]) & ~y).sum() <= 0.05 * (~y).sum()


def test_candidates_are_seen_whole():
    key = "Zq8Rt5Yp3Lk9Wd2Xc7VZ"
    text = f"see {'some/dotted.path/' * 6}{key} now, abcdefghijklmnopqr, {key}0123456789abcdef{key}!"
    found = secret_scan.candidates(text, secret_scan.base_spans(text))
    assert [(text[a:b], label) for a, b, label, _ in found] == [(text[4:4 + 17 * 6 + 20], False), ("abcdefghijklmnopqr", False), (f"{key}0123456789abcdef{key}", True), (key, None), (key, None)]
    n = secret_scan.LENGTH
    parts = [found[0][3][i:i + n] for i in range(0, len(found[0][3]), n)]
    assert all(len(p) == n for p in parts) and any(key in p for p in parts)
    assert found[2][3][secret_scan.BEFORE:].startswith("0123456789abcdef")


def test_threshold_is_the_recall_point():
    """Labels that the windows hardly tell apart have a recall point far below 0.9."""
    rng = random.Random(9)
    seen = [secret_scan.window("".join(rng.choice("abcdef0123456789") for _ in range(20)), 0, 20) for _ in range(400)]
    labels = np.array([rng.random() < 0.5 for _ in seen])
    model = secret_scan.learn(seen, labels)
    held = np.arange(400) % 5 == 4
    p = secret_scan.probabilities(model, [w for w, h in zip(seen, held, strict=True) if h])
    assert (p[labels[held]] >= model["threshold"]).mean() >= secret_scan.RECALL
    assert model["false_positive_rate"] == (p[~labels[held]] >= model["threshold"]).mean()
