"""Find secrets: fixed patterns, and a character convolutional network over every other candidate, what base spans leave of one, and what surrounds it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read_table, row_key, text_batches, written

# The patterns of the base kinds, in order, and how long what they find has to be.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more are the long ones among the greedy runs of [0-9a-f]+
KINDS = ("assign", "access", "hex", "cnn")
LEAST = {"assign": 12, "access": 18}
HINTS = ("passw", "secret", "token", "apikey", "api_key")  # every match of ASSIGN contains one of them in lower case

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
BEFORE, INSIDE, AFTER = 24, 40, 8     # characters the network sees at once
STRIDE = 20                            # from one window on a longer candidate to the next
PASSES, SHARD = 4, 20_000              # passes over all training windows, and how many of them a task has
LEAST_STEPS = 300                      # of a task in all passes; a table with few windows is gone over more often
BUFFER = 8192                          # windows that a task holds at once
GRID = 2.0**24                         # averages are rounded to it, so that the order in which tasks end does not matter
RECALL = 0.95                          # of held-out labelled secrets that the threshold must find
MASK = "[secret]"

_CLASSES = ["\0", " \t\r\n", "\"'`", ":", "=", "_-", "./", "+", "@", "0123456789", "abcdef", "ghijklm", "nopqrst", "uvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]
_CODE = np.full(65536, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _CODE[ord(_c)] = _k
N_CODES, LENGTH, WIDTH, FILTERS = len(_CLASSES) + 2, BEFORE + INSIDE + AFTER, 5, 24


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start, then kind."""
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def window(text: str, start: int, end: int) -> str:
    """What the network sees of a candidate: fixed lengths of what stands before it, of itself and after it, filled with NUL."""
    return (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:min(end, start + INSIDE)].ljust(INSIDE, "\0") + text[end:end + AFTER].ljust(AFTER, "\0"))


def windows_over(text: str, start: int, end: int) -> str:
    """The windows that cover a candidate, one after another; the last ends where the candidate does."""
    return "".join(window(text, min(at, max(start, end - INSIDE)), end) for at in range(start, max(start, end - INSIDE) + STRIDE, STRIDE))


def candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, bool | None, str]]:
    """(start, end, label, windows) of every candidate; label: a base span overlaps it.

    A labelled one is seen from where its first base span begins. What base spans leave of it follows with a null label: scored, not learned from.
    """
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        at, first, j = m.start(), None, k
        while j < len(spans) and spans[j][0] < m.end():
            a, b, _ = spans[j]
            j += 1
            if b <= m.start():
                continue
            if first is None:
                first = len(out)
                out.append((m.start(), m.end(), True, window(text, max(a, m.start()), m.end())))
            if at < a and any(map(str.isalnum, text[at:a])):
                out.append((at, a, None, windows_over(text, at, a)))
            at = max(at, b)
        if first is None:
            out.append((m.start(), m.end(), False, windows_over(text, m.start(), m.end())))
        elif at < m.end() and any(map(str.isalnum, text[at:m.end()])):
            out.append((at, m.end(), None, windows_over(text, at, m.end())))
    return out


def codes(windows) -> np.ndarray:
    """Character classes; a candidate's inside has its own code for NUL padding through position."""
    flat = np.frombuffer("".join(w[:LENGTH].ljust(LENGTH, "\0") for w in windows).encode("utf-32-le", "replace"), np.uint32)
    return np.where(flat < 65536, _CODE[np.minimum(flat, 65535)], len(_CLASSES)).reshape(-1, LENGTH)


class CharCnn:
    """Embedding by class and zone, one convolution, maxima before and from the candidate's start, and a logistic output."""

    PARTS = ("k", "b", "v", "c")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = rng.normal(0, 0.15, (WIDTH, N_CODES, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.15, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.m = {p: np.zeros_like(getattr(self, p)) for p in self.PARTS}  # running means of gradients and of their squares
        self.s = {p: np.zeros_like(getattr(self, p)) for p in self.PARTS}
        self.t = 0.0

    def vector(self) -> np.ndarray:
        """Parameters and the state of their fit."""
        return np.concatenate([*[a[p].ravel() for a in (vars(self), self.m, self.s) for p in self.PARTS], [self.t]]).astype(float)

    def load(self, vector: np.ndarray) -> CharCnn:
        at = 0
        for target in (vars(self), self.m, self.s):
            for p in self.PARTS:
                size, shape = target[p].size, target[p].shape
                target[p] = vector[at:at + size].reshape(shape).astype(np.float32)
                at += size
        self.t = float(vector[at])
        return self

    def forward(self, x: np.ndarray):
        # a convolution over one-hot classes is a sum of rows of the kernel, one per offset
        n = LENGTH - WIDTH + 1
        z = self.b + sum(self.k[o][x[:, o:o + n]] for o in range(WIDTH))
        cut = BEFORE - WIDTH + 1
        at = np.stack([z[:, :cut].argmax(1), cut + z[:, cut:].argmax(1)], 1)
        top = np.take_along_axis(z, at.reshape(len(x), 2, FILTERS), 1)
        h = np.maximum(top, 0).reshape(len(x), -1)
        return at, h, h @ self.v + self.c[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + 512])[2] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 128, seed: int = 7, share: float | None = None) -> CharCnn:
        """Steps over the given windows, from where the last ones ended. share: of secrets among all windows, if these are a part of them."""
        rng = np.random.default_rng(seed)
        share = (y == 1).mean() if share is None else share
        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
        m, s = self.m, self.s
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i:i + batch]
                xb = x[pick].copy()
                xb[rng.random(len(pick)) < 0.3, :BEFORE] = 0  # secrets also stand without a telling word before them
                at, h, z = self.forward(xb)
                d = (1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)
                dh = (d[:, None] * self.v) * (h > 0)
                gk = np.zeros_like(self.k)
                rows = np.arange(len(pick))[:, None]
                f = np.tile(np.arange(FILTERS), 2)
                for o in range(WIDTH):
                    np.add.at(gk[o], (xb[rows, at.reshape(len(pick), -1) + o], f[None, :].repeat(len(pick), 0)), dh)
                grads = {"k": gk, "b": dh.reshape(-1, 2, FILTERS).sum((0, 1)), "v": h.T @ d + 1e-3 * self.v, "c": np.array([d.sum()])}
                self.t += 1
                for p in self.PARTS:
                    m[p] = 0.9 * m[p] + 0.1 * grads[p]
                    s[p] = 0.999 * s[p] + 0.001 * grads[p] ** 2
                    setattr(self, p, (getattr(self, p) - 0.01 * (m[p] / (1 - 0.9**self.t)) / (np.sqrt(s[p] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32))
        return self


def best_logits(net: CharCnn, windows) -> np.ndarray:
    """The network's highest output over the windows of each candidate."""
    if not len(windows):
        return np.zeros(0, np.float32)
    starts = np.cumsum([0, *(len(w) // LENGTH for w in windows)])
    out = net.logits(codes([w[i:i + LENGTH] for w in windows for i in range(0, len(w), LENGTH)]))
    return np.maximum.reduceat(out, starts[:-1])


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the probability of a secret given the network's output, by Newton steps with a little damping."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g, h = p - y, p * (1 - p) + 1e-4
        hess = np.array([[(h * logit * logit).sum() + 1.0, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1.0]])
        step = np.linalg.solve(hess, [(g * logit).sum() + (a - 1), g.sum() + b])
        a, b = float(np.clip(a - step[0], 0.05, 20)), float(np.clip(b - step[1], -20, 20))
    return a, b


def learn(windows, labels: np.ndarray) -> dict | None:
    """What ``fit`` does, for candidates in memory. Network, calibration, threshold and the share of unlabelled candidates it lets through; a fifth of the findings is held out for the last three.

    The threshold is the recall point of the held-out labelled findings. None without both labels.
    """
    y = labels.astype(np.float32)
    test = np.arange(len(y)) % 5 == 4
    held = [w for w, t in zip(windows, test, strict=True) if t]
    parts = [[w[i:i + LENGTH] for i in range(0, len(w), LENGTH)] for w, t in zip(windows, test, strict=True) if not t]
    of = np.repeat(np.flatnonzero(~test), [len(p) for p in parts])
    if not (0 < y[test].sum() < test.sum() and 0 < y[~test].sum() < (~test).sum()):
        return None
    net = CharCnn().fit(codes([w for p in parts for w in p]), y[of])
    logit = best_logits(net, held)
    a, b = calibrate(logit, y[test])
    p = _chance(a, b, logit)
    threshold = float(np.quantile(p[y[test] == 1], 1 - RECALL, method="lower"))
    return {"net": net, "slope": a, "offset": b, "threshold": threshold, "false_positive_rate": float((p[y[test] == 0] >= threshold).mean())}


def probabilities(model: dict, windows) -> np.ndarray:
    return _chance(model["slope"], model["offset"], best_logits(model["net"], windows))


def _chance(slope: float, offset: float, logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * logit + offset, -30, 30)))


_FOUND = "base array<struct<start:int,stop:int,kind:string>>, cand array<struct<start:int,stop:int,label:boolean,seen:string>>"


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, cand) of every row, from the whole text; written once, as training and scoring both read it."""
    text_batches(docs.sparkSession)

    @F.pandas_udf(_FOUND)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            base = [base_spans(t) if t else [] for t in batch]
            cand = [candidates(t, s) if t else [] for t, s in zip(batch, base, strict=True)]
            yield pd.DataFrame({"base": [[dict(zip(("start", "stop", "kind"), s, strict=True)) for s in spans] for spans in base],
                                "cand": [[dict(zip(("start", "stop", "label", "seen"), c, strict=True)) for c in spans] for spans in cand]})

    return written(docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), found("text").alias("f")).select("doc_id", "row_key", "f.*"))


def fit(found: DataFrame) -> dict | None:
    """Learn from every labelled candidate: a fifth of them, by a hash of row and place, is held out for calibration and threshold.

    In each pass every task goes over its part of the training windows, and the networks of all tasks are averaged by their windows.
    None without both labels on both sides.
    """
    place = F.xxhash64("row_key", F.col("c.start"))
    flat = found.select("row_key", F.explode("cand").alias("c")).select(place.alias("place"), (F.pmod(place, F.lit(5)) == 4).alias("held"), F.col("c.label").alias("label"), F.col("c.seen").alias("seen")).filter("label IS NOT NULL")
    windows = (F.length("seen") / LENGTH).cast("long")
    counts = {(r["held"], r["label"]): r["n"] for r in flat.groupBy("held", "label").agg(F.sum(windows).alias("n")).collect()}
    if len(counts) < 4:
        return None
    net = _trained(flat.filter("NOT held"), counts[False, True], counts[False, False])

    def judged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_logits(net, batch.column(1).to_pylist()))], names=["label", "logit"])

    held = written(flat.filter("held").select("label", "seen").mapInArrow(judged, "label boolean, logit float"))
    slope, offset = _calibrated(held)
    threshold = float(_chance(slope, offset, np.array([_lower_quantile(held.filter("label"), 1 - RECALL)], np.float32))[0])
    passes = F.pandas_udf(lambda logit: pd.Series(_chance(slope, offset, logit.to_numpy()) >= threshold), "boolean")
    rate = held.filter("NOT label").agg(F.avg(passes("logit").cast("int"))).first()[0]
    return {"net": net, "slope": slope, "offset": offset, "threshold": threshold, "false_positive_rate": rate}


def _trained(rows: DataFrame, secrets: int, others: int) -> CharCnn:
    """A network from windows of rows (place, label, seen), of which so many are secrets and others. Rows are placed by their hash, so that reruns agree."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    total = secrets + others
    shards = -(-total // SHARD)
    again = max(1, -(-LEAST_STEPS // (PASSES * -(-total // (shards * 128)))))
    parts = written(rows.select("place", "label", "seen").repartition(shards, "place").sortWithinPartitions("place", "label", "seen"))
    net = CharCnn()
    for number in range(PASSES):
        start = net.vector()

        def run(batches):
            mine, x, y, n = CharCnn().load(start), [], [], 0

            def step():
                mine.fit(codes(x), np.array(y, np.float32), again, seed=1000 * number + 7, share=secrets / total)
                x.clear(), y.clear()

            for batch in batches:
                for label, seen in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    x += [seen[i:i + LENGTH] for i in range(0, len(seen), LENGTH)]
                    n += len(seen) // LENGTH
                    y += [label] * (len(x) - len(y))
                    if len(x) >= BUFFER:
                        step()
            if x:
                step()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([[float(n), *(mine.vector() * n)]])], names=["v"])

        sums = parts.mapInArrow(run, "v array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()["v"]
        net.load(np.rint(np.array(sums[1:]) / sums[0] * GRID) / GRID)
    return net


def _calibrated(held: DataFrame) -> tuple[float, float]:
    """``calibrate`` over a table (label, logit)."""
    a, b, z = 1.0, 0.0, F.col("logit").cast("double")
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * z + b))))
        g, h = p - F.col("label").cast("double"), p * (1 - p) + 1e-4
        gz, g1, hzz, hz, h1 = held.agg(*[F.sum(e) for e in (g * z, g, h * z * z, h * z, h)]).first()
        step = np.linalg.solve([[hzz + 1.0, hz], [hz, h1 + 1.0]], [gz + (a - 1), g1 + b])
        old, a, b = (a, b), float(np.clip(a - step[0], 0.05, 20)), float(np.clip(b - step[1], -20, 20))
        if abs(a - old[0]) + abs(b - old[1]) < 1e-9:
            break
    return round(a, 9), round(b, 9)


def _lower_quantile(rows: DataFrame, q: float) -> np.float32:
    """The logit at place floor(q (n - 1)) of all in order, exactly: counted by the upper half of its bits, then by all of them."""
    @F.pandas_udf("int")
    def ordered(logit: pd.Series) -> pd.Series:
        bits = logit.to_numpy(np.float32).view(np.int32)
        return pd.Series(np.where(bits < 0, bits ^ 0x7FFFFFFF, bits))

    keys, before, found = rows.select(ordered("logit").alias("key")), int(q * (rows.count() - 1)), None
    for part in (F.shiftright("key", 16), F.col("key")):
        bins = keys.filter(F.lit(True) if found is None else F.shiftright("key", 16) == found).groupBy(part.alias("bin")).count().collect()
        for found, n in sorted(bins):
            if before < n:
                break
            before -= n
    return np.array([found if found >= 0 else found ^ 0x7FFFFFFF], np.int32).view(np.float32)[0]


def scan(found: DataFrame, model: dict | None) -> DataFrame:
    """found with spans: the base spans, and as kind ``cnn`` the candidates without one, and what they leave of others, that score at or above the threshold."""
    if model is None:
        return found.withColumn("spans", F.col("base"))

    @F.pandas_udf("array<boolean>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            flat = [w for seen in batch for w in seen]
            good = probabilities(model, flat) >= model["threshold"] if flat else np.zeros(0, bool)
            ends = np.cumsum([len(seen) for seen in batch])
            yield pd.Series([good[e - len(seen):e].tolist() for e, seen in zip(ends, batch, strict=True)])

    rest = found.withColumn("rest", F.filter("cand", lambda c: ~F.coalesce(c["label"], F.lit(False))))
    some = rest.withColumn("good", scored(F.transform("rest", lambda c: c["seen"])))
    added = F.transform(F.filter(F.arrays_zip("rest", "good"), lambda z: z["good"]), lambda z: F.struct(z["rest"]["start"].alias("start"), z["rest"]["stop"].alias("stop"), F.lit("cnn").alias("kind")))
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(F.concat("base", added), rank))
    return some.select("doc_id", "row_key", "base", F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found secret replaced by MASK and n_chars, if there, counted again; documents without one are unchanged.

    Null and empty texts hold none. Repeated rows are treated alike. No rows: no rows. Other columns pass through.
    """
    model = fit(findings(docs))

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: mask(t, all_spans(t, model)) if t else None)

    name = free_name(docs, "masked")
    rows = docs.withColumn(name, masked("text"))
    changed = F.col(name) != F.col("text")
    new = {"text": F.when(changed, F.col(name)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def all_spans(text: str, model: dict | None) -> list[tuple[int, int, str]]:
    """Base spans and the network's, by start."""
    spans = base_spans(text)
    rest = [c for c in candidates(text, spans) if not c[2]] if model else []
    if rest:
        good = probabilities(model, [c[3] for c in rest]) >= model["threshold"]
        spans = sorted(spans + [(c[0], c[1], "cnn") for c, g in zip(rest, good, strict=True) if g])
    return spans


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, stop)
    return "".join(out) + text[at:]


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = findings(read_table(spark, folder, "documents").select("doc_id", "text"))
    scanned = scan(found, fit(found))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    return scanned.select("doc_id", *map(_count, KINDS[:3]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
