"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is reduced to its letters (lower-cased) and the marks that combine with them, with one space between words. Character n-grams of NGRAMS orders are
hashed into BUCKETS; a feature is the n-gram's share of the text's n-grams times its inverse document frequency.
The model is fitted by follow-the-regularised-leader with elastic-net penalties (per-coordinate steps, weights of
exactly zero), on at most ``train_rows`` labelled training documents: those with the smallest hash of their id,
so the sample is the same however the table is dealt. Each sampled text, whole, is reduced to its n-gram counts
(at most BUCKETS) in the tasks, and only those are collected. A share of the sample is kept for temperature calibration.
Prediction reads every whole text, in batches, and needs no shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties between classes go to the
first in the alphabet; without any labelled training document every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import filter_batches, map_batches, table, texts

#: Production parameters. TRAIN_ROWS bounds what the fit collects, whatever the corpus.
NGRAMS, BUCKETS, TRAIN_ROWS, FOLDS, HELD_OUT = (1, 2, 3), 1 << 15, 3000, 5, 0
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 1e-4, 1e-4, 4, 16


def grams(many: list[str], orders: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of the n-grams of all texts, one after another, and their number by text. buckets: a power of two."""
    clean = [_letters(t) for t in many]
    sizes = np.array([len(c) for c in clean], np.int64)
    code = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    out = []
    for n in orders:
        h = np.full(max(len(code) - n + 1, 0), n * 0x9E3779B9 % (1 << 32), np.uint32)
        for k in range(n):
            h = (h ^ code[k : k + len(h)]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        keep = np.ones(len(h), bool)
        for k in range(1, n):  # those that would reach into the next text
            cross = ends - k
            keep[cross[(cross >= 0) & (cross < len(h)) & (sizes >= k)]] = False
        out.append(((h[keep] & np.uint32(buckets - 1)).astype(np.int32), np.maximum(sizes - n + 1, 0)))
    return out


class _OnlyLetters(dict):
    """For str.translate: letters and combining marks stay, everything else becomes a space."""

    def __missing__(self, code: int) -> int:
        import unicodedata

        self[code] = out = code if unicodedata.category(chr(code))[0] in "LM" else 32
        return out


_TABLE = _OnlyLetters()


def _letters(text: str) -> str:
    """Words with a space around each; nothing, if marks are all there is."""
    words = text.lower().translate(_TABLE).split()
    out = f" {' '.join(words)} " if words else ""
    return out if any(map(str.isalpha, set(out))) else ""


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # buckets x classes, times idf
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...] = NGRAMS

    def logits(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits by text, and whether the text has a letter."""
        out, some = np.zeros((len(many), len(self.classes))), np.zeros(len(many), bool)
        at = 0
        while at < len(many):  # about a million characters at a time
            end, size = at, 0
            while end < len(many) and (end == at or size + len(many[end]) <= 1_000_000):
                size += len(many[end])
                end += 1
            found = grams(many[at:end], self.orders, len(self.weights))
            n = sum(k for _, k in found)
            some[at:end] = n > 0
            for rows, k in found:
                full = np.flatnonzero(k)
                start = (np.cumsum(k) - k)[full]
                for c in range(len(self.classes) if len(full) else 0):
                    out[at + full, c] += np.add.reduceat(self.weights[:, c].take(rows), start, dtype=np.float64)
            out[at:end] /= np.maximum(n, 1)[:, None]
            at = end
        return out + self.bias, some

    def predict(self, many: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not many or not self.classes:
            return ["und"] * len(many), np.zeros(len(many))
        z, some = self.logits([t or "" for t in many])
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.classes[k] if s else "und" for k, s in zip(best, some)], np.where(some, p.max(axis=1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """FTRL-proximal: z and n accumulate by coordinate, and weights follow from them in closed form."""

    def __init__(self, rows: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        w = self.weights(rows)
        sigma = (np.sqrt(self.n[rows] + gradient**2) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += gradient - sigma * w
        self.n[rows] += gradient**2


def counts(many: list[str], orders: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets of each text's n-grams, and how many fall into each."""
    parts = [np.split(rows, np.cumsum(k)[:-1]) for rows, k in grams(many, orders, buckets)] if many else []
    return [np.unique(np.concatenate(own), return_counts=True) for own in zip(*parts)]


def fit(many: list[str], labels: list[str], orders: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS, epochs: int = EPOCHS) -> Model:
    """Texts and their labels to a calibrated model."""
    return fit_counts(counts(many, orders, buckets), labels, orders, buckets, epochs)


def fit_counts(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], orders: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS, epochs: int = EPOCHS) -> Model:
    """``counts`` of texts and their labels to a calibrated model; every fifth text serves calibration alone."""
    classes = sorted(set(labels))
    if not classes:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, orders)
    y = np.array([classes.index(x) for x in labels])
    n = np.array([c.sum() for _, c in rows], np.int64)
    df = np.bincount(np.concatenate([r for r, _ in rows]) if rows else [], minlength=buckets)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    scale = 10.0  # shares of n-grams are small; weights stay near 1
    feats = [(r, c / max(k, 1) * idf[r] * scale) for (r, c), k in zip(rows, n)]
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held & (n > 0))
    model = Ftrl(buckets + 1, len(classes), ALPHA, BETA, L1, L2)
    rng = np.random.default_rng(42)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            if not len(batch):
                continue
            touched, inverse = np.unique(np.concatenate([feats[i][0] for i in batch]), return_inverse=True)
            x = np.zeros((len(batch), len(touched) + 1))
            x[np.repeat(np.arange(len(batch)), [len(feats[i][0]) for i in batch]), inverse] = np.concatenate([feats[i][1] for i in batch])
            x[:, -1] = 1.0
            at = np.append(touched, buckets)
            p = softmax(x @ model.weights(at))
            p[np.arange(len(batch)), y[batch]] -= 1
            model.step(at, x.T @ p / len(batch))
    w = model.weights()
    out = Model(classes, np.asfortranarray((w[:-1] * (idf * scale)[:, None]).astype(np.float32)), w[-1], 1.0, orders)
    keep = np.flatnonzero(held & (n > 0))
    if len(keep):
        z = np.array([out.weights[rows[i][0]].T.astype(np.float64) @ rows[i][1] / n[i] for i in keep]) + out.bias
        grid = np.geomspace(0.05, 20, 121)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(keep)), y[keep]], 1e-12)).mean() for t in grid]
        out.temperature = float(grid[int(np.argmin(loss))])
    return out


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    """Whether the document is kept from training."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from a bounded sample of the labelled documents outside the held-out fold."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    known = known.withColumn("o", F.xxhash64(F.col("doc_id"), F.lit(7)))
    # a bound on the hash first, so that no task sends more than its share of the sample
    n = known.select("o").agg(F.count("*")).first()[0]
    share = min(1.0, 1.5 * rows / n) if n else 1.0
    known = known.filter(F.col("o") <= int((share - 0.5) * 2.0**64) if share < 1 else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts([t])[0] for t in batch.column("text").to_pylist()]
            cols = [pa.array([x.astype(np.int32).tobytes() for x in part], pa.binary()) for part in zip(*found)] or [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("o", "doc_id", "lang")), *cols], names=["o", "doc_id", "lang", "buckets", "times"])

    sample = map_batches(known.select("o", "doc_id", "lang", "text"), run, "o long, doc_id long, lang string, buckets binary, times binary").orderBy("o", "doc_id", "lang", "buckets", "times").limit(rows).collect()
    return fit_counts([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.times, np.int32)) for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(texts(docs), run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, whole rows, whose language is known and at least so sure."""

    def keep():
        def good(batch: pa.RecordBatch) -> list[bool]:
            lang, score = model.predict(batch.column("text").to_pylist())
            return [x != "und" and s >= least for x, s in zip(lang, score.tolist())]

        return good

    return filter_batches(docs, keep)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
