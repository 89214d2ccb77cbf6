"""Main text of web pages: boosted trees judge elements, and a decision over the whole tree keeps the verdicts consistent."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import free_name, read_table, text_batches
from .html_dom import BAD_TAGS, BAD_TOKENS, FEATURES, GOOD_TAGS, GOOD_TOKENS, Dom

SAMPLE_PAGES = 240    # pages to learn from, expected
SAMPLE_NODES = 120    # elements of each page variant
VARIANTS = 6
SURE = 12.0           # log-odds of a verdict count up to this


def labels(dom: Dom) -> np.ndarray:
    """1 for elements inside an article or on the way to one, 0 for boilerplate and what is inside it, -1 where the page's own landmarks do not tell.

    The innermost landmark at or above an element decides, but nothing inside boilerplate is article.
    """
    n = len(dom.tag)
    out = np.full(n, -1)
    for e in range(1, n):
        above = out[dom.parent[e]]
        bad = dom.tag[e] in BAD_TAGS or any(t in BAD_TOKENS for t in dom.tokens[e])
        good = dom.tag[e] in GOOD_TAGS or any(t in GOOD_TOKENS for t in dom.tokens[e])
        out[e] = 0 if bad or (above == 0 and dom.depth[e] > 1) else 1 if good or above == 1 else -1
    for e in range(n - 1, 0, -1):
        if out[e] == 1 and out[dom.parent[e]] == -1:
            out[dom.parent[e]] = 1
    for e in range(1, n):  # outside every landmark of a page that has an article
        if out[e] == -1 and (out == 1).any():
            out[e] = 0
    return out


def variants(page: str, rng: random.Random) -> Iterator[str]:
    """The page, and the page with other markup for the same parts and with more boilerplate around and inside the article."""
    yield page
    words = re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", page[:4000])) or ["text"]

    def said(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    def boiler(inside: bool) -> str:
        kind = rng.choice(sorted(BAD_TAGS - {"head", "select", "button"})) if rng.random() < 0.5 else "div"
        token = f' class="{rng.choice(sorted(BAD_TOKENS))}{rng.choice(["", " box", "-wrap"])}"' if kind == "div" or rng.random() < 0.4 else ""
        inner = rng.choice((f"<p>{said(rng.randint(2, 60))}</p>", f"<ul><li><a href='/'>{said(2)}</a></li><li><a href='/'>{said(1)}</a></li></ul>", said(rng.randint(1, 30)), f"<h3>{said(2)}</h3><p>{said(rng.randint(5, 40))}</p><p>{said(9)}</p>"))
        return f"<{kind}{token}>{inner}</{kind}>"

    for _ in range(VARIANTS - 1):
        new = page
        if rng.random() < 0.7:
            token = rng.choice(("article", "post", "entry-content", "main-content", "story", "body text", "content"))
            tag = rng.choice(("div", "section", "main"))
            new = re.sub(r"<article[^>]*>", f'<{tag} {rng.choice(("class", "id"))}="{token}">', new).replace("</article>", f"</{tag}>")
        if rng.random() < 0.5:
            new = re.sub(r"<nav[^>]*>", f'<div class="{rng.choice(("menu", "nav", "navbar", "navigation top"))}">', new).replace("</nav>", "</div>")
        if rng.random() < 0.5:
            new = re.sub(r"<footer[^>]*>", f'<div id="{rng.choice(("footer", "site-footer", "copyright"))}">', new).replace("</footer>", "</div>")
        if rng.random() < 0.4:
            new = new.replace("<body>", "<body><div class='page'><div>").replace("</body>", "</div></div></body>")
        parts = re.split(r"(?=<p>)|(?<=</nav>)|(?<=</footer>)|(?=</body>)", new)
        for _ in range(rng.randint(1, 4)):
            parts.insert(rng.randint(min(2, len(parts)), len(parts)), boiler(True))
        if rng.random() < 0.4:
            k = rng.randrange(len(parts))
            parts.insert(k, rng.choice((f"<blockquote>{said(12)}</blockquote>", f"<ul><li>{said(6)}</li><li>{said(3)}</li></ul>", f"<h2>{said(3)}</h2>", f"<table><tr><td>{said(2)}</td><td>{said(1)}</td></tr></table>")) if k > len(parts) // 2 and "<p>" in parts[k - 1] else "")
        yield "".join(parts)


def fit(pages: DataFrame) -> Boosted | None:
    """Trees learned from about SAMPLE_PAGES pages whose own landmarks label their elements; None if no page tells anything."""
    text_batches(pages.sparkSession)
    known = pages.select("html").filter(F.col("html").isNotNull())
    total = known.count()
    if not total:
        return None
    chosen = known.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < SAMPLE_PAGES / total * (1 << 30))

    @F.pandas_udf("array<binary>")
    def described(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            out = []
            for page in batch:
                rng, rows = random.Random(len(page)), []
                for variant in variants(page, rng):
                    dom = Dom(variant)
                    y, x = labels(dom), dom.statistics()
                    told = np.flatnonzero(y >= 0)
                    told = told[np.random.default_rng(len(page)).permutation(len(told))[:SAMPLE_NODES]]
                    rows.append(np.hstack([x[told], y[told, None]]).astype(np.float32).tobytes())
                out.append(rows)
            yield pd.Series(out)

    got = chosen.select(F.xxhash64("html").alias("k"), described("html").alias("rows")).dropDuplicates(["k"]).toPandas().sort_values("k")
    tables = [np.frombuffer(r, np.float32).reshape(-1, len(FEATURES) + 1) for rows in got["rows"] for r in rows]
    data = np.concatenate(tables) if tables else np.zeros((0, len(FEATURES) + 1), np.float32)
    x, y = data[:, :-1], data[:, -1].astype(float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    return Boosted().fit(x, y, weight)


def decide(dom: Dom, log_odds: np.ndarray) -> np.ndarray:
    """True for article elements: the most probable choice in which everything inside boilerplate is boilerplate.

    Bottom up, an element is worth the better of two: boilerplate with all that it holds, or article with each child at its best.
    """
    s = np.clip(log_odds, -SURE, SURE)
    yes, no = -np.logaddexp(0, -s), -np.logaddexp(0, s)
    out_all, best = no.copy(), np.zeros(len(s))
    inside = yes.copy()
    for e in range(len(s) - 1, 0, -1):
        best[e] = max(inside[e], out_all[e])
        p = dom.parent[e]
        inside[p] += best[e]
        out_all[p] += out_all[e]
    keep = np.zeros(len(s), bool)
    keep[0] = True
    for e in range(1, len(s)):
        keep[e] = keep[dom.parent[e]] and inside[e] >= out_all[e]
    return keep


def with_headings(dom: Dom, keep: np.ndarray) -> np.ndarray:
    """On a page without any landmark, a heading goes with what follows it: kept if it has a later sibling that is."""
    lost = [e for e in range(1, len(dom.tag)) if not keep[e] and keep[dom.parent[e]] and re.fullmatch("h[1-6]", dom.tag[e])]
    if lost and (labels(dom)[1:] == -1).all():
        last = {dom.parent[e]: e for e in range(1, len(dom.tag)) if keep[e]}
        keep = keep.copy()
        for e in lost:
            keep[e] = last.get(dom.parent[e], 0) > e
    return keep


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """pages with text (article blocks in page order, one per line) and n_chars, from the whole html.

    Null and empty html, and pages without an article, give an empty text. Parsing takes time in proportion to the page, however broken. Without a model every block is kept that no
    landmark marks as boilerplate. Repeated rows get equal results. No rows: no rows. Other columns pass through, except
    those named like an added one.
    """
    text_batches(pages.sparkSession, 64)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            doms = [Dom(page or "") for page in batch]
            if model is None:
                verdicts = [labels(d) != 0 for d in doms]
            else:
                stats = [d.statistics() for d in doms]
                ends = np.cumsum([len(s) for s in stats])
                scores = model.log_odds(np.concatenate(stats)) if stats else np.zeros(0)
                verdicts = [with_headings(d, decide(d, scores[e - len(d.tag):e])) for d, e in zip(doms, ends, strict=True)]
            yield pd.Series(["\n".join(line for e, line in d.blocks if keep[e] and e) for d, keep in zip(doms, verdicts, strict=True)])

    added = ("text", "n_chars")
    name = free_name(pages, "main_text")
    rows = pages.withColumn(name, main_text("html"))
    return rows.select(*[c for c in pages.columns if c not in added], F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
