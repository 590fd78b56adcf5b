"""Toxicity by maximum-scoring segments of token log-odds.

Fit: on at most ``train_rows`` labelled documents, those with the least hashes of their
ids. The documents of each class that hold a word or word beginning are counted (once each,
as repeated lines are no further evidence); their log-odds with an informative Dirichlet
prior give a unit's score and, by its variance, its z-value. Every unit in MIN_DOCS counted
documents has a score; as the sample is bounded, so is their number.

Score: a token has the log-odds of its most certain unit, if that is at least LEAST with a
z-value of at least Z, or tells of a clean text with a z-value of at least CLEAN_Z; any other
token DRIFT. A linear scan finds all maximal scoring segments of a document. Under random
clean tokens the best segment's score follows an extreme-value law, so a segment's surprise
is lambda * score - ln(K * tokens): lambda is solved from the clean tokens' scores and K is
the likeliest one for the best segments of sample documents that are clean and were not
counted. A segment is significant if its surprise is above 0. The best surprise, the sum of
the significant ones, their number, the tokens of high score in them and the length go
through a logistic fit on the sample rows that were not counted.

Null and empty texts have no segment; the logistic scores them as it does any text without
one, which is well below the base rate where most labels are clean. Without labels of both
classes the score is that rate (0 without any label). Repeated rows are scored alike, label
rows that repeat count repeatedly, null labels are left out, other columns are not read. A
row without an id is neither held out nor learned from.
Texts are taken whole; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, few_files, slices, stage, table, texts

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)
TRAIN_ROWS = 16000
#: Of ten parts of the sample, those that are counted; the others calibrate.
COUNTED = 7
Z = 3.8
LEAST = 1.0
#: z-value from which a unit tells of clean texts.
CLEAN_Z = 3.8
#: Score from which a token of a significant segment counts as strong.
STRONG = 1.5
FEATURES = ("best", "total", "size", "strong", "count")
MIN_DOCS = 3
DRIFT = -0.1
PRIOR = 5.0
#: Marks of the numbers of documents and tokens among the units.
ALL, TOKENS = "<documents>", "<tokens>"


def units(token: str) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    return [token + " ", *(token[:k] for k in PREFIXES if len(token) > k)]


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in linear time.

    ``scores`` holds the (place, score) of the tokens that don't score ``drift``. Each
    candidate keeps the running total before its start and at its end; a new one joins the
    nearest earlier candidate that starts lower, if it also ends higher than that one.
    """
    found: list[list] = []  # first, last, total before, total at the end, link
    total, at = 0.0, -1
    for place, s in scores:
        total += drift * (place - at - 1)
        before, total, at = total, total + s, place
        if s <= 0:
            continue
        new = [place, place, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, r - low) for a, b, low, r, _ in found]


@dataclass
class Model:
    scores: dict[str, tuple[float, float]] = field(default_factory=dict)  # unit -> (log-odds, z)
    rate: float = 1.0  # lambda
    k: float = 0.1
    base: float = 0.0
    weights: np.ndarray | None = None  # intercept and one per feature
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def token(self, t: str) -> float:
        s = self.known.get(t)
        if s is None:
            hits = [self.scores[u] for u in units(t) if u in self.scores]
            s = max(hits, key=lambda h: h[1])[0] if hits else DRIFT
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[t] = s
        return s

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments, by token place."""
        tokens = TOKEN.findall(text.lower()) if text else []
        return len(tokens), segments([(i, s) for i, s in enumerate(map(self.token, tokens)) if s != DRIFT])

    def features(self, text: str | None) -> tuple[float, ...]:
        tokens = TOKEN.findall(text.lower()) if text else []
        hits = [(i, s) for i, s in enumerate(map(self.token, tokens)) if s != DRIFT]
        known, n = math.log(self.k * len(tokens) + 1), math.log1p(len(tokens))
        found = [(self.rate * s - known, a, b) for a, b, s in segments(hits)]
        sure = [x for x in found if x[0] > 0]
        strong, at = 0, 0
        for i, s in hits:  # both are in order of place
            while at < len(sure) and sure[at][2] < i:
                at += 1
            strong += s >= STRONG and at < len(sure) and sure[at][1] <= i
        return max((x[0] for x in found), default=-known), sum(x[0] for x in sure), n, float(min(3, strong)), float(min(3, len(sure)))

    def state(self) -> dict:
        """Plain values for a broadcast, which names classes by module."""
        return {k: v for k, v in vars(self).items() if k != "known"}

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        z = np.clip((np.clip(x, -60, 60) - self.mean) / self.scale @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition of the bounded sample."""
    times: dict[int, int] = {0: 0, 1: 0}
    docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for part in (x for whole in parts for x in slices(whole)):
        for text, label in zip(texts(part.column(0)), part.column(1).to_pylist(), strict=True):
            tokens = TOKEN.findall((text or "").lower())
            times[label] += len(tokens)
            docs[label].update({u for t in set(tokens) for u in units(t)})
            docs[label][ALL] += 1
    rows = [(u, label, n) for label in docs for u, n in docs[label].items()] + [(TOKENS, label, n) for label, n in times.items()]
    u, label, n = zip(*rows, strict=True)
    yield pa.RecordBatch.from_pydict({"unit": pa.array(u), "label": pa.array(label, pa.int32()), "d": pa.array(n, pa.int64())})


def _rate(scores: np.ndarray, times: np.ndarray) -> float | None:
    """lambda with mean exp(lambda * score) = 1 over clean tokens."""
    low, high = 1e-3, 10.0
    share = times / times.sum()
    if share @ scores >= 0 or scores.max() <= 0:
        return None
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * scores, 500)) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a slight ridge."""
    x = np.clip(x, -60, 60)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.0, *[0.3] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, a.T @ (p - y) + ridge @ w), -4, 4)
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """labels: (doc_id, toxic). Only the bounded sample's counts and features reach the driver."""
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") != 0).cast("int").alias("label"), F.xxhash64("doc_id", F.lit(11)).alias("u"))
    ids = stage(chosen.orderBy("u", "label").limit(train_rows), "toxic-ids")
    seen = dict(ids.groupBy("label").count().collect())
    model = Model(base=seen.get(1, 0) / max(1, sum(seen.values())))
    if len(seen) < 2:
        return model
    # at most train_rows ids of 20 bytes: the bound that lets them be broadcast
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label", F.pmod(F.col("u"), F.lit(10)).alias("part")), "toxic-sample")
    counted = sample.where(F.col("part") < COUNTED)
    sums = counted.select("text", "label").mapInArrow(_count, "unit string, label int, d long")
    sums = sums.groupBy("unit").agg(*(F.sum(F.when(F.col("label") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in (0, 1)))
    sums = stage(sums.where((F.col("d0") + F.col("d1") >= MIN_DOCS) | F.col("unit").isin(ALL, TOKENS)), "toxic-units")
    marks = {r.unit: r for r in sums.where(F.col("unit").isin(ALL, TOKENS)).collect()}
    n0, n1 = (marks[ALL].d0, marks[ALL].d1) if ALL in marks else (0, 0)
    if not n0 or not n1:
        return model
    prior = F.lit(0.5) + PRIOR * (F.col("d0") + F.col("d1")) / float(n0 + n1)
    odds = F.log((F.col("d1") + prior) / (n1 + PRIOR + 1)) - F.log((F.col("d0") + prior) / (n0 + PRIOR + 1))
    z = odds / F.sqrt(1 / (F.col("d1") + prior) + 1 / (F.col("d0") + prior))
    toxic = (F.col("z") >= Z) & (F.col("odds") >= LEAST) & (F.col("d1") >= MIN_DOCS)
    kept = sums.where(~F.col("unit").isin(ALL, TOKENS)).select("unit", odds.alias("odds"), z.alias("z"), "d0", "d1").where(toxic | (F.col("z") <= -CLEAN_Z))
    rows = kept.orderBy("unit").collect()  # units of a bounded sample
    model.scores = {r.unit: (r.odds if r.odds > 0 else min(r.odds, DRIFT), abs(r.z)) for r in rows}
    words = [r for r in rows if r.unit.endswith(" ")] or rows
    if words:  # clean tokens: each kept word as often as clean documents hold it, DRIFT for the rest
        odds_of, times = np.array([model.scores[r.unit][0] for r in words]), np.array([r.d0 + 0.1 for r in words])
        model.rate = _rate(np.append(odds_of, DRIFT), np.append(times, max(1.0, marks[TOKENS].d0 - times.sum()))) or model.rate
    rest = sample.where(F.col("part") >= COUNTED).select("text", "label")
    best = featurise(rest.where("label = 0"), model, "label int").select("best", "size").collect()  # at most train_rows numbers
    if best:  # with surprises s for K = k: K * n * exp(-lambda * x) = exp(-s) * K / k has the mean 1
        over = np.array([math.exp(min(50.0, -r.best)) for r in best])
        model.k *= 1 / max(over.mean(), 1e-9)
    feats = np.array([tuple(r) for r in featurise(rest, model, "label int").collect()], float)
    if len(feats) and 0 < feats[:, -1].sum() < len(feats):
        model.weights, model.mean, model.scale = _logistic(feats[:, :-1], feats[:, -1])
    return model


def featurise(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    """The features of the text in the first column, then the second column."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # units of a bounded sample

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for part in (x for whole in parts for x in slices(whole)):
            rows = [m.features(t) for t in texts(part.column(0))]
            cols = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*cols, part.column(1)], names=[*FEATURES, part.schema.names[1]])

    return docs.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + f", {keep}")


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the passages (token places and scores) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for part in (x for whole in parts for x in slices(whole)):
            p = m.probability(np.array([m.features(t) for t in texts(part.column(1))]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxic_passages(docs: DataFrame, model: Model, surprise: float = 3.0) -> DataFrame:
    """One row per significant segment: doc_id, first and last token, score and surprise."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for part in (x for whole in parts for x in slices(whole)):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                n, found = m.passages(text)
                rows += [(key, a, b, s, x) for a, b, s in found if (x := m.rate * s - math.log(m.k * n + 1)) >= surprise]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "first", "last", "score", "surprise"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first long, last long, score double, surprise double")


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows whose predicted label is not 1, with all their columns."""
    model = fit(docs, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    place = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for part in (x for whole in parts for x in slices(whole)):
            p = m.probability(np.array([m.features(t) for t in texts(part.column(place))]).reshape(-1, len(FEATURES)))
            yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = few_files(score_toxicity(docs, model))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
