"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model by dual coordinate descent.

An n-gram is three bytes of the text, or two neighbouring words' shapes (case,
digits, first and last character's kind, length, whether a word repeats the one
before it). N-grams are hashed to ``BUCKETS``; a document has each at most once.
Margins become probabilities by a logistic fit on rows that the model has not
seen. The model is fitted on at most ``TRAIN_ROWS`` labelled rows and has a fixed
size; every document is scored on its whole text.

A null or empty text has no n-grams and gets the bias's score. Labels of one kind
only, or none, give that share as every score. Repeated rows give repeated
results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, span_hashes, table, text_bytes, word_spans
from .labelled import held_out, training_rows

TRAIN_ROWS = 6000
BYTE_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 12
BUCKETS = BYTE_BUCKETS + SHAPE_BUCKETS
THRESHOLD = 0.3
_KIND = np.zeros(256, np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4
for _k, _c in enumerate("!?.,;:'\"()|*#$%&@/-_=+<>[]{}", 5):
    _KIND[ord(_c)] = _k


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams of a slice, with repeats."""
    n = len(raw)
    of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    text, bucket = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    if n >= 3:
        wide = raw.astype(np.uint32)
        code = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)
        inside = of[:-2] == of[2:]
        text.append(of[:-2][inside])
        bucket.append((code >> np.uint32(18))[inside].astype(np.int64))
    starts, ends, _ = word_spans(raw, offsets)
    if len(starts) > 1:
        size = ends - starts
        upper = np.append(0, np.cumsum(_KIND[raw] == 2))
        digit = np.append(0, np.cumsum(_KIND[raw] == 1))
        words = span_hashes(raw, starts, ends)
        again = np.append(False, words[1:] == words[:-1])
        shape = _KIND[raw[starts]]
        for more in (_KIND[raw[ends - 1]], np.minimum(size, 15), np.minimum(upper[ends] - upper[starts], 2), np.minimum(digit[ends] - digit[starts], 2), again.astype(np.int64)):
            shape = shape * 41 + more
        pair = mix((shape[:-1] * 1_000_003 + shape[1:]).astype(np.uint64))
        word_of = of[starts]
        inside = word_of[:-1] == word_of[1:]
        text.append(word_of[:-1][inside])
        bucket.append(BYTE_BUCKETS + (pair & np.uint64(SHAPE_BUCKETS - 1)).astype(np.int64)[inside])
    return np.concatenate(text), np.concatenate(bucket)


def indicators(column: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    raw, offsets = text_bytes(column)
    out = np.zeros((len(column), BUCKETS), np.uint8)
    text, bucket = ngrams(raw, offsets)
    out.reshape(-1)[text.astype(np.int64) * BUCKETS + bucket] = 1
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, found: np.ndarray) -> np.ndarray:
        margin = np.array([row @ self.weights for row in found.astype(np.float32)]) if len(found) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 1) -> Model:
    """NB-SVM on sparse rows (bucket numbers) and 0/1 labels."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 20 or share in (0.0, 1.0):
        clipped = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(clipped / (1 - clipped))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    sums = np.ones((2, BUCKETS))
    for k in used:
        sums[labels[k], rows[k]] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    y = 2.0 * labels - 1
    weight_of = {1: cost * 0.5 / share, 0: cost * 0.5 / (1 - share)}
    square = {k: float((ratio[rows[k]] ** 2).sum()) + 1.0 for k in used}
    w, bias, alpha = np.zeros(BUCKETS), 0.0, dict.fromkeys(used.tolist(), 0.0)
    scale = np.mean(list(square.values()))  # keeps the step size independent of the texts' length
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(used).tolist():
            x = rows[k]
            gradient = y[k] * (w[x] @ ratio[x] + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), weight_of[int(labels[k])] / scale)
            step = (new - alpha[k]) * y[k]
            if step:
                w[x] += step * ratio[x]
                bias += step
                alpha[k] = new
                moved += abs(step)
        if moved * scale < 1e-3 * len(used):
            break
    weights = w * ratio
    margin = np.array([weights[rows[k]].sum() + bias for k in aside])
    slope, shift = calibrate(margin, labels[aside])
    return Model(weights.astype(np.float32), float(bias), slope, shift)


def calibrate(margin: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of labels on margins, by Newton's method, with Platt's smoothed targets."""
    if not len(labels):
        return 1.0, 0.0
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))])
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -1, 1)
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows; their n-grams, at most ``limit`` x ``BUCKETS``, go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [np.flatnonzero(row).astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32).tobytes() for row in indicators(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    rows = training_rows(docs, labels, label, limit).select(F.col("doc_id").cast("long"), "text", "label")
    got = sorted(rows.mapInArrow(run, "doc_id long, label int, found binary").collect())
    return fit([np.frombuffer(r.found, np.uint16).astype(np.int64) for r in got], np.array([r.label for r in got], np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for part in slices(batch.slice(start, 256), "text"):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(indicators(part.column(1))), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for part in slices(batch.slice(start, 256), "text"):
                    yield part.filter(pa.array(shared.value.scores(indicators(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
