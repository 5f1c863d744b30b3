"""Quality classifier: a linear SVM over n-gram indicators scaled by naive-Bayes log-count ratios (Wang and Manning 2012).

Features are n-grams that a text has at least once: word uni- and bigrams, uni-, bi- and trigrams of word shapes (letters, capitals
and digits as classes, runs as one), so that words never seen before still say something, and two that stand for any word twice or
three times in a row. They are hashed into BUCKETS; those that no training text has weigh nothing. Each
indicator is scaled by r = log((p / |p|) / (q / |q|)) of its smoothed counts in the two classes; a hinge-loss model is fitted to
these by dual coordinate descent (Hsieh et al. 2008), interpolated with its mean weight, and its margin is turned into a
probability by a logistic curve fitted to rows kept out of the descent.

It is fitted on labelled rows on the driver: those with the smallest hash of their id, at most SAMPLE_ROWS of them and no more than
have SAMPLE_FEATURES features together (documented bounds; 4 bytes a feature). Every text is scored whole, one at a time. Labels, languages, sources and ids are no inputs of a score.

Null and empty texts have no features; their score is that of the bias. Rows with null labels are not learned from; a repeated
id is learned from each time. With one class only, every score is 1 or 0 accordingly; without labelled rows it is 0.5. Extra
columns are ignored, also where their names are those of the result; an empty table gives no rows. Ids that are no numbers are
null. A score of exactly the threshold is predicted 1; rows whose hashes tie are taken by id and label.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import WordHashes, lean, mix64, small_batches, written

BUCKETS = 1 << 20
SAMPLE_ROWS, SAMPLE_FEATURES = 6000, 40_000_000
THRESHOLD = 0.3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class ShapeHashes(WordHashes):
    """Hashes of the shapes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(_RUN.sub(rb"\1", word.translate(_SHAPE)), seed=7)
        return value


class Features:
    """The buckets of the n-grams of texts."""

    def __init__(self) -> None:
        self.words, self.shapes = WordHashes(), ShapeHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = text.split() if text else []
        if not found:
            return np.empty(0, np.int64)
        w = np.frombuffer(array("Q", map(self.words.__getitem__, found)), np.uint64)
        s = np.frombuffer(array("Q", map(self.shapes.__getitem__, found)), np.uint64)
        two = s[:-1] * _STEP + s[1:]
        three = two[:-1] * _STEP + s[2:]
        same = w[1:] == w[:-1]
        again = np.array([101] * bool(same.any()) + [102] * bool((same[1:] & same[:-1]).any()), np.uint64)
        grams = np.concatenate([w, w[:-1] * _STEP + w[1:] + np.uint64(5), again, np.unique(s) + np.uint64(1), np.unique(two) + np.uint64(2), np.unique(three) + np.uint64(3)])
        return np.unique((mix64(grams) % np.uint64(BUCKETS)).astype(np.int64))


@dataclass
class Model:
    weights: np.ndarray  # of scaled indicators, already times their ratio
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    for f, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge losses, by dual coordinate descent over the rows x = r[f]."""
    w, bias = np.zeros(BUCKETS), 0.0
    values = [r[f] for f in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            f, v, label = rows[i], values[i], y[i]
            gradient = label * (float(w[f] @ v) + bias) - 1
            projected = min(gradient, 0) if alpha[i] <= 0 else max(gradient, 0) if alpha[i] >= cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
                step = (new - alpha[i]) * label
                alpha[i] = new
                w[f] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with the smoothed targets of Platt."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margins).sum() + 1e-4 * a, (p - t).sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-4, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], labels: list[int], mixing: float = 0.5) -> Model:
    y = np.where(np.array(labels) == 1, 1, -1)
    if not len(rows):
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    if abs(y.sum()) == len(y):
        return Model(np.zeros(BUCKETS), 40.0 * y[0], 1.0, 0.0)
    r = ratios(rows, y)
    kept = np.arange(len(rows)) % 5 == 0  # for the curve
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept = np.ones(len(rows), bool)
        used = kept
    else:
        used = ~kept
    some = [f for f, u in zip(rows, used, strict=True) if u]
    r = ratios(some, y[used])
    w, bias = dual_descent(some, y[used], r)
    w = mixing * w + (1 - mixing) * np.abs(w).mean()
    weights = w * r
    seen = np.zeros(BUCKETS, bool)
    for f in some:
        seen[f] = True
    weights[~seen] = 0
    margins = np.array([weights[f].sum() + bias for f, k in zip(rows, kept, strict=True) if k])
    return Model(weights.astype(np.float32), bias, *calibrated(margins, y[kept]))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on labelled rows whose id is not held out."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = chosen.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype(np.int32).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "label", "features"])

    # At most sample_rows rows of 12 bytes: a bounded broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    held = written(rows.mapInArrow(run, "doc_id long, label int, features binary"), "features")
    size = held.select("doc_id", "label", F.xxhash64("features").alias("digest"), (F.octet_length("features") / 4).alias("n"))  # of at most sample_rows ids
    fits = size.withColumn("sum", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "digest"))).agg(F.max(F.when(F.col("sum") <= sample_features, F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))).alias("last")).first()["last"]
    if fits is None:
        return fit([], [])
    last = F.struct(F.lit(fits["h"]).alias("h"), F.lit(fits["doc_id"]).alias("doc_id"))
    held = held.filter(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id") <= last)  # no more than sample_features features come back, but for repeated ids
    found = sorted(map(tuple, held.collect()), key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0], x[1], x[2]))
    return fit([np.frombuffer(f, np.int32).astype(np.int64) for _, _, f in found], [y for _, y, _ in found])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = [m.score(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose own text scores threshold or more, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for b in batches:
            keep = [m.score(features(t)) >= threshold for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
