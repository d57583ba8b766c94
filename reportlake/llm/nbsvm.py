"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators.

Features are n-grams of bytes, of words and of word shapes (case, punctuation at the ends, repetition of the word
before), hashed to a fixed range. Indicators are scaled by class log-count ratios and a linear
hinge-loss model is fitted by dual coordinate descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed
from .textnum import Words, chunks, mix

DIM = 1 << 17
#: At most so many labelled rows are fitted; the sample is the rows with the smallest hashes.
MAX_ROWS = 16_000
#: And at most so many features of them, 12 bytes each: rows in the order of their hashes until these are full.
MAX_FEATURES = 24_000_000
#: Texts whose features are marked at a time, 128 KB each, and bytes of text that are in memory as numbers.
TOGETHER = 64
CHUNK = 1 << 18
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_ALNUM[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(DIM - 1)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct features of each text, in order; some texts at a time, so that short ones don't add up."""
    parts = [_features(data[offsets[i] : offsets[min(i + TOGETHER, len(offsets) - 1)]], offsets[i : i + TOGETHER + 1] - offsets[i]) for i in range(0, len(offsets) - 1, TOGETHER)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([t + i * TOGETHER for i, (t, _) in enumerate(parts)]), np.concatenate([f for _, f in parts])


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    seen = np.zeros(n * DIM, bool)
    if len(data) >= 3:
        b = data.astype(np.uint64)
        gram = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        of = np.repeat(np.arange(n), np.diff(offsets))
        ok = of[:-2] == of[2:]
        seen[(of[:-2] * DIM + _slot(gram, 1))[ok]] = True
    w = Words(data, offsets)
    if len(w.hash):
        seen[w.text * DIM + _slot(w.hash, 2)] = True
        first, last, second = data[w.start], data[w.end - 1], data[np.minimum(w.start + 1, w.end - 1)]
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        shape = (
            np.where(_ALNUM[last], 0, last).astype(np.uint64) | np.where(_ALNUM[first], 0, first).astype(np.uint64) << np.uint64(8)
            | _UPPER[first].astype(np.uint64) << np.uint64(16) | _UPPER[second].astype(np.uint64) << np.uint64(17) | same.astype(np.uint64) << np.uint64(18)
        )
        for k in (1, 2, 3):
            at = w.windows(k)
            code = shape[at]
            for i in range(1, k):
                code = mix(code) + shape[at + i]
            seen[w.text[at] * DIM + _slot(code, 2 + k)] = True
    hits = np.flatnonzero(seen)
    return hits // DIM, hits % DIM


@dataclass
class Model:
    """Fixed size: one weight a feature slot, an intercept and a calibration to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feat = features(data, offsets)
        margin = np.bincount(doc, self.weights[feat], len(offsets) - 1)
        norm = np.sqrt(np.maximum(1, np.bincount(doc, minlength=len(offsets) - 1)))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin / norm + self.bias) + self.shift, -500, 500)))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches, limit=CHUNK):
        doc, feat = features(data, offsets)
        at = np.searchsorted(doc, np.arange(len(offsets)))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feat, pa.int32()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], names=["doc_id", "label", "features"])


def fit_rows(x: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, keep: float = 0.25, seed: int = 5) -> Model:
    """Fit on feature lists and labels 0/1. With one class only the model gives its smoothed share."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n0 or not n1:
        return Model(np.zeros(DIM), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    # one class after the other: nothing but the features themselves is as long as all of them
    count = lambda label: alpha + np.bincount(np.concatenate([f for f, v in zip(x, y, strict=True) if v == label]), minlength=DIM)
    pos, neg = count(1), count(0)
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    # dual coordinate descent of the hinge loss; each row is scaled to its number of features
    w, bias, dual = np.zeros(DIM), 0.0, np.zeros(len(x))
    small = ratio.astype(np.float32)
    values = [small[f] / np.float32(np.sqrt(max(1, len(f)))) for f in x]
    square = np.array([float(v @ v) + 1 for v in values])
    sign = np.where(y == 1, 1.0, -1.0)
    cost = c * np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            grad = sign[i] * (values[i] @ w[x[i]] + bias) - 1
            new = min(max(dual[i] - grad / square[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                w[x[i]] += step * values[i]
                bias += step
                dual[i] = new
    # interpolation with the mean weight, as naive Bayes support vectors do
    scaled = ((1 - keep) * np.abs(w).mean() + keep * w) * ratio
    margin = np.array([scaled[f].sum() / np.sqrt(max(1, len(f))) for f in x]) + bias * keep
    slope, shift = _calibrate(margin, y)
    return Model(scaled, bias * keep, slope, shift)


def _calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic fit of labels on margins by Newton steps, with smoothed targets."""
    scale = margin.std() or 1.0
    m = margin / scale
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -2, 2), b - np.clip(d[1], -2, 2)
    return float(a / scale), float(b)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, left = [], MAX_FEATURES
    for b in batches:
        for d, label, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            left -= len(f.values)
            if left >= 0:
                # a copy, so that the batch can go
                rows.append((d, label, np.array(f.values, np.int32)))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    m = fit_rows([f for _, _, f in rows], np.array([label for _, label, _ in rows], float)) if rows else Model(np.zeros(DIM), 0.0, 0.0, 0.0)
    yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id, quality) with text in ``docs``.

    Rows with a null label are left out; a doc_id with several labels counts once with its smallest, and rows that share a doc_id share its label. The sample is broadcast
    (its size is bounded), so documents are not shuffled; fitting takes the sample's features, at most ``MAX_FEATURES``, in one task. Without rows the model scores one half.
    """
    sample = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    found = chosen.mapInArrow(_featurize, "doc_id long, label int, features array<int>").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    row = found.mapInArrow(_fit, "weights binary, bias double, slope double, shift double").first()
    if row is None:
        return Model(np.zeros(DIM), 0.0, 0.0, 0.0)
    return Model(np.frombuffer(row.weights, np.float64).copy(), row.bias, row.slope, row.shift)


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches, limit=CHUNK):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(data, offsets))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in [0, 1] of every document from its text alone; null and empty texts are scored by the intercept."""
    return keyed(docs).select("doc_id", "text").mapInArrow(partial(_score, model), "doc_id long, score double")


def _keep(model: Model, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches, limit=CHUNK):
        yield rows.filter(pa.array(model.score(data, offsets) >= threshold))


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; nothing is shuffled."""
    return docs.mapInArrow(partial(_keep, model, threshold), docs.schema)
