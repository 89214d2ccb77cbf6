"""Predict the language of a text: its family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table, text_batches

# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
SAMPLE_PER_LANGUAGE = 400   # labelled rows to learn from, expected; the rest of the corpus is only predicted
SAMPLE_ROWS = 12_000        # in all, expected; more languages get fewer rows each
DIM = 4096                  # hashed byte bigrams and trigrams
UNKNOWN = "und"
LEAST_SCORE = 0.2           # below it the pipeline rejects a document

_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts of the whole lower-cased text, at unit length; runs of non-letters are one space."""
    x = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    space = x == 32
    x = x[np.append(~(space[1:] & space[:-1]), True)]
    two = (x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    out = np.bincount(two, minlength=DIM).astype(np.float32)
    if len(x) > 2:
        three = (x[:-2] * np.uint32(0xC2B2AE35) + x[1:-1] * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)) >> np.uint32(20)
        out += np.bincount(three, minlength=DIM)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, y in {-1, 1}, classes weighted alike; accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * len(y)
    a = np.hstack([x, np.ones((len(x), 1), np.float32)])
    step = 1.0 / (1.0 + 2 * c * float((weight * (a * a).sum(axis=1)).sum()) / len(y))
    w = look = np.zeros(a.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ look))
        new = look - step * (look - 2 * c * (a.T @ (weight * y * slack)) / len(y))
        look, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, with smoothed targets."""
    high, low = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - t, p * (1 - p) + 1e-6
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(m, np.array([(g * margin).sum(), g.sum()]))
        a, b = float(np.clip(a - d[0], 0.1, 50)), float(np.clip(b - d[1], -20, 20))
    return a, b


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """A machine on all rows, and a calibration from machines on halves that judge the other half."""
    margins = np.zeros(len(y))
    for half in (0, 1):
        own = np.arange(len(y)) % 2 == half
        if len(set(y[own])) == 2:
            w, b = train_svm(x[own], y[own])
            margins[~own] = x[~own] @ w + b
    w, b = train_svm(x, y)
    return w, b, *platt(margins, y)


def train(langs: np.ndarray, x: np.ndarray) -> dict:
    """The two levels: a one-against-rest machine per family, and within each family a machine per pair of languages."""
    family = np.array([FAMILY_OF.get(k, k) for k in langs])
    names = sorted(set(family))
    model = {"families": names, "top": [], "members": {}, "pairs": {}}
    for f in names if len(names) > 1 else []:
        model["top"].append(machine(x, np.where(family == f, 1.0, -1.0)))
    for f in names:
        members = sorted(set(langs[family == f]))
        model["members"][f] = members
        for a, b in combinations(members, 2):
            rows = (langs == a) | (langs == b)
            model["pairs"][a, b] = machine(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
    return model


def predict(model: dict, x: np.ndarray) -> tuple[str, float]:
    def probability(m) -> float:
        w, b, slope, offset = m
        return float(1 / (1 + np.exp(-np.clip(slope * (x @ w + b) + offset, -30, 30))))

    tops = np.array([probability(m) for m in model["top"]]) if model["top"] else np.ones(1)
    best = int(tops.argmax())
    score = float(tops[best] / max(tops.sum(), 1e-9))
    members = model["members"][model["families"][best]]
    wins, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
    for a, b in combinations(members, 2):
        p = probability(model["pairs"][a, b])
        wins[a], wins[b] = wins[a] + (p >= 0.5) + p / 1e3, wins[b] + (p < 0.5) + (1 - p) / 1e3
        least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
    lang = max(members, key=lambda k: wins[k])
    return lang, score * least[lang]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves 2 when divided by 4. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_features(docs: DataFrame) -> pd.DataFrame:
    """(lang, x) of about SAMPLE_PER_LANGUAGE labelled rows of each language, chosen by a hash of the id; features of their whole texts."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()  # one row per language
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS / max(len(counts), 1))
    rate = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(each / r["count"])) for r in counts]) if counts else F.lit(0.0)
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))

    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: features(t).astype(np.float16).tobytes() if has_letter(t) else None)

    return chosen.select("doc_id", "lang", packed("text").alias("x")).filter("x IS NOT NULL").toPandas().sort_values(["doc_id", "lang"])


def fit(docs: DataFrame) -> dict | None:
    """The model learned from docs (doc_id, text, lang); None if there is nothing to learn from."""
    text_batches(docs.sparkSession)
    sample = sample_features(docs)
    if sample.empty:
        return None
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in sample["x"]])
    return train(sample["lang"].to_numpy(), x)


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text alone.

    Null texts and texts without a letter, and all texts if the model is None: ``und`` with score 0. Repeated rows get
    equal results. No rows: no rows. Other columns pass through, except those named like an added one.
    """
    text_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([predict(model, features(t)) if has_letter(t) else (UNKNOWN, 0.0) for t in batch], columns=["lang_pred", "score"])

    name = free_name(docs, "judged")
    rows = docs.drop("lang_pred", "score").withColumn(name, judged("text"))
    return rows.select(*[c for c in rows.columns if c != name], f"{name}.lang_pred", f"{name}.score")


def keep_identified(docs: DataFrame, model: dict | None, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language is unknown or scores below least."""
    return identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = identify(docs.select("doc_id", "text"), fit(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
