"""Logistic regression on sparse rows, for the classifiers of this subpackage.

A model is fitted on the driver from a bounded sample of labelled rows: `sample_rows` is
that bound. Scoring runs in Arrow batches on the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse rows: of row i the columns ids[ptr[i]:ptr[i + 1]], two bytes each, with their values in single floats, or 1 without; columns have a scale each. Products go through them in blocks."""

    BLOCK = 1 << 20

    def __init__(self, ids: list[np.ndarray], scale: np.ndarray, values: list[np.ndarray] | None = None):
        self.ptr = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        self.values = np.concatenate(values) if values else None
        self.scale, self.width = scale, len(scale)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def _blocks(self):
        """(first row, row after the last, each entry's row among these, its column, its value)."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + self.BLOCK, "right")) - 1)
            at = slice(self.ptr[lo], self.ptr[hi])
            yield lo, hi, np.repeat(np.arange(hi - lo), np.diff(self.ptr[lo : hi + 1])), self.ids[at], 1.0 if self.values is None else self.values[at]
            lo = hi

    def dot(self, w: np.ndarray) -> np.ndarray:
        scaled = self.scale * w
        out = [np.bincount(row, scaled[ids] * values, hi - lo) for lo, hi, row, ids, values in self._blocks()]
        return np.concatenate(out) if out else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for lo, hi, row, ids, values in self._blocks():
            out += np.bincount(ids, g[lo:hi][row] * values, self.width)
        return out * self.scale


def fit(rows: Rows, y: np.ndarray, penalty: float, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression (Adam on the whole sample)."""
    w, b = np.zeros(rows.width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m = v = np.zeros(rows.width + 1)
    for t in range(1, steps + 1):
        miss = (sigmoid(rows.dot(w) + b) - y) / max(1, len(y))
        g = np.append(rows.back(miss) + penalty * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn held-out scores into probabilities; Newton steps."""
    up, down = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * z + b)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (d * z).sum() + 1e-3 * (a - 1), d.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - scale * da, b - scale * db
        if abs(da) + abs(db) < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, where=None) -> DataFrame:
    """doc_id, text and 0/1 label of a sample of `sample_rows` rows at most.

    The labelled ids with the smallest hash are taken, so the sample doesn't depend on file
    order, and one text of each: of an id that repeats, the least. Picked ids are few by that
    bound, hence broadcast. An id with several labels counts as 1 if one of them is.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.where(where)
    picked = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
