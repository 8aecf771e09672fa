"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores.

Labels are given for documents, so token labels come first: a token's features are the word and its first
4, 5 and 6 letters (inflected forms share them); candidates are features far more frequent in toxic than in
other training documents; those with significant support among toxic documents that are no copies of one
another (a word that only rides along in copies of one document has next to none) mark the labelled tokens. The field has two states, a weight for each candidate, a constant one, and transition
weights; it is trained by forward-backward on windows around all candidates and elsewhere, equal windows counted on the executors.

Scoring is exact over whole texts: words without a weight of their own share one transfer matrix, so a
stretch of g of them is that matrix to the power g, and only candidates are visited one by one. A document's
score is a logistic function of its highest marginal and its expected number of toxic words, and the
offending offsets are the words with a marginal of at least 1/2.

Bounds, as parameters: TOXIC_ROWS and OTHER_ROWS labelled training documents (by hash of doc_id); the link from marginals to the
score weighs both kinds by all their labels, so its 1/2 means the same however large the corpus. Only the
sample's candidates and different windows go to the driver. Learning uses no row whose
crc32(doc_id) mod 5 is 0; neither lang, source nor doc_id is an input of a score.

Defined results: a null or empty text has no words and gets the background score. Without toxic training
rows every score is 0. Repeated label rows count once, as toxic if any of them is; null labels are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, cut, give_back, id_and_text, small_batches, table, tidy, whole_text
from .runs import runs

TOXIC_ROWS, OTHER_ROWS = 4_000, 8_000
LEAST_DOCS, LEAST_RATIO = 3, 20.0
PREFIXES = (4, 5, 6)
#: The least share of a feature's toxic documents that must be no copies of one another.
COPIES = 0.3
WINDOW = 8
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»„“”¿¡…"


@dataclass(frozen=True)
class Field:
    """Log weights of state 1 against state 0; state 0 weighs nothing."""

    words: dict[str, float] = field(default_factory=dict)
    other: float = -8.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # from 0 to 0, 0 to 1, 1 to 0, 1 to 1
    link: tuple[float, float, float] = (0.0, 0.0, -30.0)  # of the score: highest marginal's logit, log of the expected number, constant

    @property
    def step(self) -> tuple[float, float, float, float]:
        return tuple(math.exp(x) for x in self.trans)

    def marginals(self, at: list[int], weights: list[float], n: int) -> list[float]:
        """P(state 1) at the positions at, whose weights are given, in a text of n words; exact."""
        t00, t01, t10, t11 = self.step
        bg = math.exp(self.other)
        power = lambda g: _power((t00, t01 * bg, t10, t11 * bg), g)
        forward, a = [], None
        for k, (p, w) in enumerate(zip(at, weights, strict=True)):
            gap = p - (at[k - 1] + 1 if k else 0)
            if a is None:
                a = (1.0, bg) if gap else None
                gap = gap - 1 if gap else 0
            if a is not None:
                if gap > 0:
                    m = power(gap)
                    a = (a[0] * m[0] + a[1] * m[2], a[0] * m[1] + a[1] * m[3])
                a = (a[0] * t00 + a[1] * t10, (a[0] * t01 + a[1] * t11) * math.exp(w))
            else:
                a = (1.0, math.exp(w))
            s = a[0] + a[1]
            a = (a[0] / s, a[1] / s)
            forward.append(a)
        out, b, later = [0.0] * len(at), (1.0, 1.0), n
        for k in range(len(at) - 1, -1, -1):
            gap = later - at[k] - 1
            if gap > 0:
                m = power(gap)
                b = (m[0] * b[0] + m[1] * b[1], m[2] * b[0] + m[3] * b[1])
            a = forward[k]
            one, none = a[1] * b[1], a[0] * b[0]
            out[k] = one / (one + none)
            e = math.exp(weights[k])
            b = (t00 * b[0] + t01 * e * b[1], t10 * b[0] + t11 * e * b[1])
            s = b[0] + b[1]
            b, later = (b[0] / s, b[1] / s), at[k]
        return out

    def background(self) -> float:
        """The marginal of a word among others that all have no weight of their own, far from the ends."""
        t00, t01, t10, t11 = self.step
        bg = math.exp(self.other)
        m = _power((t00, t01 * bg, t10, t11 * bg), 64)
        left, right = (m[0] + m[2], m[1] + m[3]), (m[0] + m[1], m[2] + m[3])
        return left[1] * right[1] / (left[0] * right[0] + left[1] * right[1])

    def features(self, found: list[float], background: float) -> tuple[float, float]:
        top = min(max(max(found, default=0.0), background, 1e-6), 1 - 1e-6)
        return math.log(top / (1 - top)), math.log1p(sum(found))

    def score(self, found: list[float], background: float) -> float:
        x, y = self.features(found, background)
        z = self.link[0] * x + self.link[1] * y + self.link[2]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@lru_cache(maxsize=8192)
def _power(m: tuple[float, ...], g: int) -> tuple[float, ...]:
    """A 2 x 2 matrix to the power g, scaled."""
    out, base = (1.0, 0.0, 0.0, 1.0), m
    while g:
        if g & 1:
            out = _times(out, base)
        base = _times(base, base)
        g >>= 1
    return out


def _times(a, b):
    c = (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3])
    s = max(c)
    return tuple(x / s for x in c)


def plain(run: str) -> str:
    return run.strip(EDGE)


def token_features(run: str) -> list[str]:
    """The word of a lower-case run, and its beginnings where it is longer."""
    word = plain(run)
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)] if word else []


def token_weight(model: "Field", run: str) -> float | None:
    """None if no feature of the run has a weight of its own."""
    own = [model.words[f] for f in token_features(run) if f in model.words]
    return model.other + sum(own) if own else None


def tagged(texts: pa.Array, model: Field) -> list[tuple[int, list[int], list[float]]]:
    """Of each text the number of words, the places of words with a weight of their own, and their marginals."""
    alone("toxicity")
    names, index, at = runs(texts, lower=True)
    weight = [token_weight(model, x) for x in names.to_pylist()]
    known = np.array([w is not None for w in weight], bool)[index] if len(index) else np.zeros(0, bool)
    places = np.nonzero(known)[0]
    cuts = np.searchsorted(places, at)
    out = []
    for i in range(len(texts)):
        own = places[cuts[i] : cuts[i + 1]]
        n = int(at[i + 1] - at[i])
        spots = (own - at[i]).tolist()
        out.append((n, spots, model.marginals(spots, [weight[index[p]] for p in own], n) if spots else []))
    return out


def spans(text: str, places: list[int], marginals: list[float], least: float = 0.5) -> list[tuple[int, int, float]]:
    """start, end and marginal of the offending words; neighbours stay apart."""
    wanted = {p: m for p, m in zip(places, marginals, strict=True) if m >= least}
    if not wanted:
        return []
    out = []
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k in wanted:
            start = m.start() + len(m[0]) - len(m[0].lstrip(EDGE))
            out.append((start, start + len(plain(m[0])), wanted[k]))
    return out


def training_rows(labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """doc_id and toxic of a bounded number of labelled rows outside the held-out fifth, and for each kind how many labelled rows one of the sample stands for."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 != 0")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    kept = [rows.where(c).orderBy("h", "doc_id").limit(n).select("doc_id", "toxic") for c, n in (("toxic = 1", toxic_rows), ("toxic = 0", other_rows))]
    ids = kept[0].unionByName(kept[1]).collect()
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for_each = {k: total.get(k, 0) / max(1, sum(r.toxic == k for r in ids)) for k in (0, 1)}
    return labels.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int"), for_each


def fit_field(ids: np.ndarray, states: np.ndarray, mask: np.ndarray, times: np.ndarray, features: int, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (0: the constant) and transitions, by gradient ascent (Adam) on the windows' likelihood.

    ids, states, mask: a row for each window; ids has each token's features, -1 where there are fewer; mask is 0 beyond a window's end.
    times: how often each window stands.
    """
    weight, trans = np.zeros(features + 1), np.zeros(4)  # the last stands for no feature and stays 0
    moment = [np.zeros(features + 5), np.zeros(features + 5)]
    n, width = mask.shape
    seen, ids = mask.astype(bool), np.where(ids < 0, features, ids)
    per = ids.shape[2]
    often = np.broadcast_to(times[:, None], mask.shape)[seen].astype(float)
    summed = lambda x: np.bincount(ids[seen].ravel(), weights=np.repeat(x * often, per), minlength=features + 1)
    counts, ones = summed(np.ones(int(seen.sum()))), summed(states[seen].astype(float))
    pair = mask[:, 1:] * mask[:, :-1] * times[:, None]
    told = np.array([(pair * (states[:, :-1] == a) * (states[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)])
    for r in range(1, rounds + 1):
        step = np.exp(trans).reshape(2, 2)
        emit = np.stack([np.ones((n, width)), np.exp(np.clip(weight[ids].sum(2), -30, 30))], axis=2)
        emit[~seen] = 1.0
        f = np.empty((n, width, 2))
        f[:, 0] = emit[:, 0]
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for k in range(1, width):
            f[:, k] = np.where(mask[:, k, None] > 0, (f[:, k - 1] @ step) * emit[:, k], f[:, k - 1])
            f[:, k] /= f[:, k].sum(1, keepdims=True)
        b = np.ones((n, width, 2))
        for k in range(width - 2, -1, -1):
            b[:, k] = np.where(mask[:, k + 1, None] > 0, (b[:, k + 1] * emit[:, k + 1]) @ step.T, b[:, k + 1])
            b[:, k] /= b[:, k].sum(1, keepdims=True)
        g = f * b
        p = g[..., 1] / g.sum(2)
        both = f[:, :-1, :, None] * step[None, None] * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
        both /= both.sum((2, 3), keepdims=True)
        expected = (both * pair[:, :, None, None]).sum((0, 1)).reshape(4)
        slope = np.concatenate([(ones - summed(p[seen])) / np.maximum(counts, 1), (told - expected) / max(1.0, pair.sum())]) - ridge * np.concatenate([weight, trans])
        slope[features] = 0.0
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope**2
        move = 0.2 * (moment[0] / (1 - 0.9**r)) / (np.sqrt(moment[1] / (1 - 0.99**r)) + 1e-9)
        move[features] = 0.0
        weight, trans = np.clip(weight + move[: features + 1], -12, 12), np.clip(trans + move[features + 1 :], -6, 6)
    return weight[:features], trans


def supported(found: list[tuple[int, list[str]]], share: float) -> set[str]:
    """Features of toxic documents whose support is no chance and no copying.

    found: of each toxic document a key that near copies mostly share, and its candidates. Support is the number of different keys. It must
    reach the count that chance would give one of a million features with probability 1/20, were a document toxic with probability share, and
    COPIES of the documents that have the feature.
    """
    least = max(LEAST_DOCS, math.ceil(math.log(0.05 / 1e6) / math.log(min(max(share, 1e-9), 0.99))))
    docs: dict[str, int] = {}
    keys: dict[str, set[int]] = {}
    for key, features in found:
        for f in features:
            docs[f] = docs.get(f, 0) + 1
            keys.setdefault(f, set()).add(key)
    return {f for f, k in keys.items() if len(k) >= max(least, COPIES * docs[f])}


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Field:
    """A field and its score's link from the labelled rows among docs."""
    small_batches(docs.sparkSession)
    rows, for_each = training_rows(labels, toxic_rows, other_rows)
    sample = cut(id_and_text(docs).join(F.broadcast(rows), "doc_id").select("toxic", "text"))

    def words(batches):
        for b in batches:
            names, index, at = runs(b.column("text"), lower=True)
            names = [token_features(x) for x in names.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([sorted({f for i in np.unique(index[x:y]) for f in names[i]}) for x, y in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.string()))], ["toxic", "words"])

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1):
        return Field()
    seen = sample.mapInArrow(tidy(words), "toxic int, words array<string>").select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    likely = seen.where((F.col("t") >= LEAST_DOCS) & (F.col("t") / totals[1] > LEAST_RATIO * (F.col("c") + 0.5) / max(1, totals.get(0, 0))))
    candidates = {r.w for r in likely.select("w").collect()}

    def told(words: list[str]) -> list[list[str]]:
        return [[f for f in token_features(x) if f in candidates] for x in words]

    def windows(batches):
        """Of each text the windows that hold all its candidates, none twice, and one of its middle."""
        for b in batches:
            kinds, out = [], []
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws, end = told(text.lower().split()), 0
                for i, w in enumerate(ws):
                    if w and i >= end:
                        low, end = max(end, i - WINDOW), i + WINDOW + 1
                        kinds.append(toxic)
                        out.append([" ".join(x) for x in ws[low:end]])
                if ws:
                    kinds.append(toxic)
                    out.append([" ".join(x) for x in ws[max(0, len(ws) // 2 - WINDOW) : len(ws) // 2 + WINDOW + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(out, pa.list_(pa.string()))], ["toxic", "window"])

    def spots(batches):
        """Of each text its candidates, and a key that near copies mostly share."""
        for b in batches:
            texts = [t.lower().split() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([min((zlib.crc32(x.encode()) for x in set(ws) if len(x) > 5), default=0) for ws in texts], pa.int64()), pa.array([sorted({f for x in told(ws) for f in x}) for ws in texts], pa.list_(pa.string()))], ["copy", "spots"])

    got = sample.mapInArrow(tidy(windows), "toxic int, window array<string>").groupBy("toxic", "window").agg(F.count("*").alias("times")).orderBy("toxic", "window").toPandas()
    held = sample.where("toxic = 1").select("text").mapInArrow(tidy(spots), "copy long, spots array<string>").collect()
    toxic_features = supported([(r.copy, r.spots) for r in held if r.spots], totals[1] / sum(totals.values()))
    number = {w: i for i, w in enumerate(["", *sorted(candidates)])}
    width, per = 2 * WINDOW + 1, 2 + len(PREFIXES)
    ids = np.full((len(got), width, per), -1, np.int32)
    states, mask = np.zeros((len(got), width), np.int8), np.zeros((len(got), width), np.int8)
    for k, (toxic, window) in enumerate(zip(got["toxic"], got["window"], strict=True)):
        mask[k, : len(window)] = 1
        ids[k, : len(window), 0] = 0
        for i, w in enumerate(window):
            if w:
                fs = w.split(" ")
                ids[k, i, 1 : 1 + len(fs)] = [number[f] for f in fs]
                states[k, i] = int(bool(toxic) and not toxic_features.isdisjoint(fs))
    weight, trans = fit_field(ids, states, mask, got["times"].to_numpy(), len(number))
    # features that hardly speak for toxicity are left to the background
    model = Field({w: float(weight[i]) for w, i in number.items() if w and weight[i] > 0.5}, float(weight[0]), tuple(map(float, trans)))
    return Field(model.words, model.other, model.trans, _link(sample, model, for_each))


def _link(sample: DataFrame, model: Field, for_each: dict[int, float]) -> tuple[float, float, float]:
    """Logistic regression of the label on the two features, over the sample, each row weighed by the labelled rows it stands for (Newton steps, a small ridge)."""
    background = model.background()

    def run(batches):
        for b in batches:
            xs = [model.features(found, background) for _, _, found in tagged(b.column("text"), model)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([x for x, _ in xs], pa.float64()), pa.array([y for _, y in xs], pa.float64())], ["toxic", "x", "y"])

    rows = sample.mapInArrow(tidy(run), "toxic int, x double, y double").collect()
    x, y = np.array([[r.x, r.y, 1.0] for r in rows]), np.array([r.toxic for r in rows], float)
    w, times = np.zeros(3), np.where(y == 1, for_each[1], for_each[0])
    times = times / times.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (times * p * (1 - p) + 1e-6)[:, None]) + 0.1 * np.eye(3), x.T @ (times * (y - p)) - 0.1 * w)
    return tuple(map(float, w))


def score_column(model: Field, text: Column) -> Column:
    """The score of a text, as a column beside all others."""
    background = model.background()

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = pd.Series([model.score(found, background) for _, _, found in tagged(pa.array(texts, pa.string()), model)], dtype="float64")
        give_back()
        return out

    return scored(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, predicted and the offending spans of every document. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    background = model.background()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        for b in batches:
            found = tagged(b.column("text"), model)
            scores = [model.score(x, background) for _, _, x in found]
            where = [[{"start": s, "end": e, "marginal": m} for s, e, m in spans(b.column("text")[i].as_py(), places, x)] if places else [] for i, (_, places, x) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(where, span)], ["doc_id", "score", "predicted", "spans"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,marginal:double>>")


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below 1/2, with all their columns."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    return docs.where(score_column(model, whole_text()) < 0.5)
