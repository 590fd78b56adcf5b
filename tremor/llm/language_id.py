"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: the character n-grams, n = 1 to
MAX_N, of its letter runs with boundary marks, hashed into BUCKETS rows. A linear softmax
follows. Embeddings and softmax are trained together in numpy by stochastic gradient
descent on at most ``train_rows`` labelled documents, those with the least hashes of their
ids, so a rerun picks the same ones. As the model is linear after the mean, prediction
needs only the product of both matrices: one row of scores per bucket.

A second part of the sample sets the temperature that calibrates the probabilities and the
score below which a prediction counts as rejected (column ``rejected``); lang_pred itself
is ``und`` only for null texts and texts without a letter, with score 0. Without labelled
rows every prediction is ``und``. A row without an id is neither held out nor learned from. Repeated rows and clashing extra columns don't matter:
only the id, the text and, in training, the label are read. Texts are taken whole; bytes
that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, chunks, crc_mod, few_files, mix64, table, texts

BUCKETS = 1 << 15
DIMS = 16
MAX_N = 4
TRAIN_ROWS = 4000
STEPS = 800
RATE = 0.5
#: Embeddings learn per row, the softmax from a batch's mean.
EMBED_RATE, SOFTMAX_RATE = 4.0, 2.0
BATCH = 32
#: Share of held-back sample rows that a rejection may cost at most.
REJECT = 0.005


def letters(cache: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    """Which code points are letters, built once a process."""
    if not cache:
        cache.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return cache[0]


def lowered(col: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(col)
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pc.utf8_lower(pa.array(texts(col), pa.string()))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, row of each subword) of lower-cased UTF-8 texts end to end.

    n-grams are over bytes' characters: a letter is what Unicode calls alphabetic;
    everything else separates, and is itself dropped but for one boundary mark.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = letters()[code]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    first = np.zeros(len(code), bool)
    first[starts[:-1][starts[:-1] < len(code)]] = True
    before = np.concatenate([[False], letter[:-1]]) & ~first
    keep = letter | before  # letters, and the separator right after a run as the boundary mark
    sym = np.where(letter, code, 1).astype(np.uint64)[keep]
    rows, mark, head = row[keep], ~letter[keep], first[keep]
    # a run that ends with its text has no separator; its n-grams just end there
    h = np.zeros(len(sym), np.uint64)
    alive = np.ones(len(sym), bool)
    out, owner = [], []
    for n in range(1, MAX_N + 1):
        # h[i]: hash of the n symbols that end at i, alive if they are in one row and run
        if n > 1:
            prev = np.concatenate([[np.uint64(0)], h[:-1]])
            ok = np.concatenate([[False], alive[:-1]]) & ~head
            ok[1:] &= ~mark[:-1]
            h, alive = prev * np.uint64(0x100000001B3) + sym, ok
        else:
            h = sym.copy()
            alive = ~mark
        if not len(h):
            break
        out.append((mix64(h[alive] + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(rows[alive])
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(owner, minlength=n)
        sums = np.stack([np.bincount(owner, weights=self.scores[buckets, k], minlength=n) for k in range(len(self.labels))], axis=1)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 0) -> Model:
    """Fit on four fifths of the rows, calibrate on the rest."""
    labels = sorted(set(langs))
    y = np.array([labels.index(x) for x in langs])
    data, offsets = buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    parts = []
    for i, j in chunks(offsets):
        b, o = subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        pairs, times = np.unique(o.astype(np.int64) * BUCKETS + b, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(j - i + 1) * BUCKETS)
        parts += [(pairs[s:e] % BUCKETS, times[s:e] / times[s:e].sum() if e > s else times[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS))
    out = np.zeros((DIMS, len(labels)))
    bias = np.zeros(len(labels))
    fit, held = np.flatnonzero(np.arange(len(y)) % 5 != 4), np.flatnonzero(np.arange(len(y)) % 5 == 4)
    held = held if len(held) else fit
    epochs = -(-STEPS // max(1, -(-len(fit) // BATCH)))
    steps = epochs * -(-len(fit) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = np.stack([parts[r][1] @ emb[parts[r][0]] if len(parts[r][0]) else np.zeros(DIMS) for r in rows])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ out.T
            out -= rate * (hidden.T @ p) / len(rows) * SOFTMAX_RATE
            bias -= rate * p.mean(axis=0) * 0.1
            for r, g in zip(rows, back, strict=True):
                emb[parts[r][0]] -= rate * EMBED_RATE * parts[r][1][:, None] * g
    model = Model(labels, emb @ out, bias)
    z = np.stack([(parts[r][1] @ model.scores[parts[r][0]] if len(parts[r][0]) else 0 * bias) + bias for r in held])
    losses = []
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = float(t)
        losses.append((-np.log(model.probabilities(z)[np.arange(len(held)), y[held]] + 1e-12).mean(), float(t)))
    model.temperature = min(losses)[1]
    best = model.probabilities(z).max(axis=1)
    model.reject_below = float(np.quantile(best, REJECT))
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, lang: str = "lang") -> Model | None:
    """Train on at most train_rows labelled rows; the sample comes to the driver, the table doesn't."""
    sample = (
        docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
        .select("doc_id", "text", lang, F.xxhash64(F.col("doc_id"), F.lit(7)).alias("u"))
        .withColumn("u2", F.xxhash64("text"))
    )
    ids = sample.select("u", "u2").orderBy("u", "u2").limit(train_rows).agg(F.max("u").alias("u"), F.count(F.lit(1)).alias("n")).first()
    if not ids["n"]:
        return None
    rows = sample.where(F.col("u") <= ids["u"]).orderBy("u", "u2").limit(train_rows).select("text", lang).collect()
    return train([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs."""
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    # plain values, as a broadcast names classes by module; BUCKETS x labels, whatever the table's size
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.scores.astype(np.float32), model.bias, model.temperature, model.reject_below))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        names = np.array([*m.labels, "und"], object)
        for part in parts:
            data, offsets = buffers(lowered(part.column(1)))
            n = part.num_rows
            pick, score = np.full(n, len(m.labels)), np.zeros(n)
            for i, j in chunks(offsets):
                b, o = subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = np.bincount(o, minlength=j - i) > 0
                p = m.probabilities(m.logits(b, o, j - i))
                pick[i:j] = np.where(some, p.argmax(axis=1), len(m.labels))
                score[i:j] = np.where(some, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang_pred": pa.array(names[pick], pa.string()), "score": pa.array(score), "rejected": pa.array(score < m.reject_below)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = few_files(identify(docs, fit(docs.where(~held))))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
