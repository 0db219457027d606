"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIZES = (3, 4, 5)
BITS = 20  # n-grams are hashed to 2**BITS features
TRAIN_ROWS = 2400  # labelled rows the model is fitted on: at most half of them of either class
TRAIN_CHARS = 50_000  # longer texts are not taken into that sample; every text is scored whole
SMOOTHING = 1.0
PENALTY = 2e-3
STEPS = 60

Model = tuple[np.ndarray, float]


class Grams:
    """Distinct hashed n-grams of a text."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts, h = [], codes
        for n in range(2, SIZES[-1] + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1:]
            if n in SIZES:
                parts.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n) >> np.uint32(32 - BITS)).astype(np.int32))
        if not parts:
            return np.zeros(0, np.int32)
        grams = np.concatenate(parts)
        place = np.arange(len(grams), dtype=np.int32)
        self.last[grams] = place  # of equal n-grams one place stays
        return grams[self.last[grams] == place]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def label_sample(labels: DataFrame, label: str, kept: Column, rows: int) -> DataFrame:
    """doc_id and label of at most rows/2 rows of each class, the first by a hash of the id.

    Null or other labels, and ids with both labels, are left out. A bounded table, small enough to broadcast.
    """
    sure = (
        labels.filter(kept & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_max")).filter("label = _max").drop("_max")
    )
    order = F.xxhash64("doc_id")
    half = [sure.filter(F.col("label") == x).orderBy(order, "doc_id").limit(rows // 2) for x in (0, 1)]
    return half[0].unionByName(half[1])


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Weights of all features and the constant, from the labelled sample (bounded, so the driver can hold it)."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "label": batch.column(1),
                "grams": pa.array([grams(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())})

    rows = (
        docs.filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(sample), "doc_id")
        .select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
        .dropDuplicates(["doc_id"]).mapInArrow(extract, "doc_id long, label int, grams binary")
        .orderBy("doc_id").toArrow()
    )
    y = np.asarray(rows.column(1).to_pylist(), np.int64)
    return solve([np.frombuffer(g, np.int32) for g in rows.column(2).to_pylist()], y)


def solve(texts: list[np.ndarray], y: np.ndarray) -> Model:
    """Naive Bayes log-count ratios r, then logistic regression on the features r * [n-gram occurs], as r * w."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-9
        return weights, float(np.log(share / (1 - share)))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = np.concatenate(texts)
    seen = np.bincount(grams, minlength=1 << BITS)
    kept = seen[grams] > 1  # an n-gram of one text says nothing about others
    owner, grams = owner[kept], grams[kept]
    used, column = np.unique(grams, return_inverse=True)
    toxic = SMOOTHING + np.bincount(column, y[owner], len(used))
    clean = SMOOTHING + np.bincount(column, 1 - y[owner], len(used))
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, (ratio * w)[column], len(y))

    def backward(e: np.ndarray) -> np.ndarray:
        return ratio * np.bincount(column, e[owner], len(used))

    v = np.ones(len(used)) / np.sqrt(len(used))
    for _ in range(12):  # the largest curvature bounds the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    heaviest = len(y) / 2 / min(np.bincount(y, minlength=2))
    rate = 1 / (0.25 * heaviest * (1.1 * norm / len(y) + 1) + PENALTY)
    weight = (len(y) / 2 / np.bincount(y, minlength=2))[y] / len(y)  # both classes count alike
    w, ahead, bias, bias_ahead = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(STEPS):  # accelerated gradient descent
        e = (1 / (1 + np.exp(-forward(ahead) - bias_ahead)) - y) * weight
        new, new_bias = ahead - rate * (backward(e) + PENALTY * ahead), bias_ahead - rate * e.sum()
        pull = step / (step + 3)
        ahead, bias_ahead = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    weights[used] = ratio * w
    return weights, float(bias)


def scorer(model: Model) -> Callable[[list[str | None]], np.ndarray]:
    weights, bias = model
    grams = Grams()

    def score(texts: list[str | None]) -> np.ndarray:
        z = np.array([weights[grams(t)].sum(dtype=np.float64) if t else 0.0 for t in texts]) + bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row of ``docs``.

    Only rows of ``labels`` (doc_id, toxic) outside the held-out fold are learned from; a score depends on the text alone.
    A null or empty text gets the constant's score; without labels of both classes the score is the share of toxic labels
    (near 0 without any). Repeated rows are scored alike; extra columns are not read. Empty tables give no rows.
    """
    kept = ~held_out(F.col("doc_id"), folds, fold)
    model = fit(docs.select("doc_id", "text").filter(kept), label_sample(labels.select("doc_id", "toxic"), "toxic", kept, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            scores = score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "score": scores,
                "predicted": (scores >= 0.5).astype(np.int32)})

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
