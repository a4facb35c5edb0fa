"""Quality scores learnt from trusted positives and unlabelled text.

A text is described by its form: shares of character-class trigrams, and how its words repeat. From trusted positives
and unlabelled texts, (1) a first separator of the two gives scores from which the share of positives among the
unlabelled is estimated on the half of each that the separator has not seen: the smallest ratio, over thresholds, of the
unlabelled to the positive share above it, with an allowance for sample size; the median of several splits counts; (2) with this prior a linear score minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

by mini-batches: where a batch's second term falls below zero, the step goes back on that term instead. Negative labels
are never used.

Only the training is bounded: at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts, the first by a hash of their id. Every
whole text is scored, where it is read, without a shuffle.

Defined results: a null or empty text has no features but its length and is scored like any other; without a positive
every score is 0.5; a document whose labels contradict each other is no positive; other columns pass through,
except one called as the output is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.llm.scratch import give_back_memory, without
from hourwatt.llm.windows import batches_of, word_codes

MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
KEEP = 0.3
BATCH_BYTES = 1 << 20
BATCH_TEXTS = 512
CLASSES = 8
STEPS, BATCH, RATE, DECAY = 3000, 512, 0.02, 1e-2
LARGEST = 8.0
SPLITS, SPLIT_STEPS, SPLIT_DECAY = 5, 300, 0.05


def _classes() -> np.ndarray:
    """Upper, lower, digit, blank, line end, sentence marks, other ASCII signs, beyond ASCII."""
    out = np.full(256, 6, dtype=np.int32)
    out[np.arange(65, 91)], out[np.arange(97, 123)], out[np.arange(48, 58)] = 0, 1, 2
    out[[32, 9, 11, 12]], out[[10, 13]], out[[ord(c) for c in ".,;:?'\"()-"]] = 3, 4, 5
    out[128:] = 7
    return out


BYTE_CLASS = _classes()
FEATURES = CLASSES**3 + 8
SHRINK_BYTES = 60


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of trigram shares, word statistics, and last how far its length can be trusted."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for part in batches_of([len(t) + 3 for t in texts], BATCH_BYTES):
        own = texts[part]
        data = np.frombuffer(b"\n\n".join(own) + b"\n\n", dtype=np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(t) + 2 for t in own])])
        kind = BYTE_CLASS[data]
        grams = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
        doc = np.repeat(np.arange(len(own)), np.diff(edges))[: len(grams)]
        inside = np.ones(len(grams), dtype=bool)
        inside[edges[1:-1] - 1], inside[edges[1:-1] - 2] = False, False  # these reach into the next text
        doc, grams = doc[inside], grams[inside]
        counts = np.bincount(doc * CLASSES**3 + grams, minlength=len(own) * CLASSES**3).reshape(len(own), -1)
        out[part, : CLASSES**3] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        starts, codes = word_codes(data)
        owner = np.searchsorted(edges, starts, side="right") - 1
        words = np.bincount(owner, minlength=len(own))
        scale = np.maximum(words, 1)
        same = np.zeros(len(codes), dtype=bool)
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        order = np.lexsort((codes, owner))
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=len(own))
        lines = np.array([t.count(b"\n") + 1 for t in own])
        sizes = np.diff(edges) - 2
        again = np.bincount(owner, same, len(own)) / scale
        extra = [np.sqrt(again), again, np.minimum(5 * again, 1), distinct / scale, np.log1p(words) / 10, np.sqrt(np.diff(edges) / scale) / 10, np.sqrt(lines / scale), sizes / (sizes + SHRINK_BYTES)]
        out[part, CLASSES**3 :] = np.stack(extra, axis=1)
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def ready(self, x: np.ndarray) -> np.ndarray:
        """Standardised features; those of short texts are drawn to the mean, for their shares are mostly noise."""
        out = x[:, :-1] - self.mean
        out /= self.scale
        np.clip(out, -LARGEST, LARGEST, out=out)
        out *= x[:, -1:]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        g = self.ready(x) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def _adam(grad, size: int, steps: int) -> np.ndarray:
    """Minimise by Adam; ``grad(theta, step)`` gives the gradient of one mini-batch."""
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(theta, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def _slope(x: np.ndarray, theta: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss of sign * g over x, and its gradient."""
    g = np.clip(sign * (x @ theta), -50, 50)
    return float(np.log1p(np.exp(-g)).mean()), -(sign / (1 + np.exp(g))) @ x / len(x)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of texts the separator has not seen."""
    at = np.unique(positive)
    above = lambda s: 1 - np.searchsorted(np.sort(s), at, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / risk) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> Model:
    """Estimate the prior, then minimise the non-negative risk."""
    rng = np.random.default_rng(seed)
    n = len(positive) + len(unlabelled)
    total = lambda f: f(positive[:, :-1]) + f(unlabelled[:, :-1])
    mean = (total(lambda x: x.sum(axis=0, dtype=np.float64)) / n).astype(np.float32)
    scale = np.sqrt(np.maximum(total(lambda x: np.einsum("ij,ij->j", x, x, dtype=np.float64)) / n - mean.astype(np.float64) ** 2, 0)).astype(np.float32)
    scale = np.where(scale > 1e-4, scale, np.float32(1))
    plain = Model(mean, scale, np.zeros(len(mean), dtype=np.float32), 0.0, 0.0)
    ready = lambda x: np.hstack([plain.ready(x), np.ones((len(x), 1), dtype=np.float32)])
    p, u = ready(positive), ready(unlabelled)

    def batch(rows: np.ndarray) -> np.ndarray:
        return rows[rng.integers(0, len(rows), min(BATCH, len(rows)))]

    priors = []
    for _ in range(SPLITS):
        (p1, p2), (u1, u2) = (np.array_split(rng.permutation(len(x)), 2) for x in (p, u))
        if not len(p2) or not len(u2):
            p2, u2 = p1, u1
        tell = _adam(lambda w, t: _slope(p[batch(p1)], w, 1)[1] + _slope(u[batch(u1)], w, -1)[1] + SPLIT_DECAY * w, p.shape[1], SPLIT_STEPS)
        priors.append(estimated_prior((p @ tell)[p2], (u @ tell)[u2]))
    prior = float(np.median(priors))

    def risk(theta: np.ndarray, t: int) -> np.ndarray:
        bp, bu = p[batch(np.arange(len(p)))], u[batch(np.arange(len(u)))]
        _, up = _slope(bp, theta, 1)
        (lp, down), (lu, other) = _slope(bp, theta, -1), _slope(bu, theta, -1)
        if lu - prior * lp < 0:
            return -(other - prior * down) + DECAY * theta
        return prior * up + other - prior * down + DECAY * theta

    theta = _adam(risk, p.shape[1], STEPS)
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def held_out(doc: str = "doc_id") -> Column:
    """The fold no label is learnt from."""
    return F.crc32(F.col(f"`{doc}`").cast("string")) % 5 == 0


def _sample(docs: DataFrame, ids: DataFrame, text: str, doc: str, most: int) -> np.ndarray:
    """Features of at most ``most`` documents, the first by a hash of their id."""
    chosen = ids.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).join(F.broadcast(chosen), "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                made = features([t or b"" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([r.tobytes() for r in made], pa.binary())], names=["place", "f"])

    # In the order of a hash of id and text: the same training set, in the same order, on every run.
    found = rows.select(F.xxhash64("id", "text").alias("place"), "text").mapInArrow(describe, "place long, f binary").toArrow().combine_chunks()
    out = np.frombuffer(b"".join(found.column("f").to_pylist()), dtype=np.float32).reshape(-1, FEATURES)
    return out[np.argsort(found.column("place").to_numpy(), kind="stable")]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality") -> Model | None:
    """Model from the labels of rows outside the held-out fold; None without a positive."""
    open_to = docs.where(~held_out(doc)).select(F.col(f"`{doc}`").alias("id"))
    sure = labels.where(~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("least"), F.max(label).alias("most"))
    positives = sure.where("least = 1 and most = 1").select("id").join(open_to, "id", "left_semi")
    p = _sample(docs, positives, text, doc, MAX_POSITIVE)
    u = _sample(docs, open_to, text, doc, MAX_UNLABELLED)
    return fit(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the quality of every whole text between 0 and 1."""
    docs = without(docs, out)
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    place, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                made = model.scores(features([(t or "").encode() for t in batch.column(place).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=names)
        give_back_memory()

    return docs.mapInArrow(run, schema)
