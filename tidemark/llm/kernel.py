"""Operator 11: a quality classifier by random Fourier features.

Statistics of every whole text (lengths, shares of kinds of characters, words and lines, repetition)
are the input of a ridge regression on random Fourier features, whose products
approximate a Gaussian kernel. Tasks add up their rows' part of the normal equations, so a
matrix of fixed size is all that leaves them, and all labelled rows take part. Isotonic
regression on a fold that the weights haven't seen turns predictions into probabilities.

Texts are scanned once: their statistics, some twenty numbers each, are kept in the shared
folder, and fitting, calibration and scoring read only these.

From the counts on, all is whole numbers: statistics, phases (looked up in one table of cosines), the
sums, and a row's prediction. So a text's score is the same beside any other rows, and a
task that runs again adds up the same sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import SPREAD, SYMBOLS, repeated_lines, repeated_words
from .shared import column, settled, widened
from .textops import SEPARATOR, Slice, mix, pieces_of, slices, windows

#: Shares are counted in parts of ONE.
ONE = 1 << 16
#: Random features; width of the kernel in standard deviations of a statistic; seed of frequencies and phases.
FEATURES, WIDTH, SEED = 192, 4.0, 11
#: Standardised statistics are cut off so many deviations from the mean, and counted in parts of UNIT.
REACH, UNIT = 6, 1 << 8
#: Phases are in parts of TURN of a full turn; cosines in parts of AMPLITUDE, weights in parts of WEIGHT.
TURN, STEPS, AMPLITUDE, WEIGHT = 1 << 24, 1 << 12, 1 << 12, 1 << 20
PENALTY = 1e-4
#: Predictions are calibrated by bins of this part of 1, from -1 to 3.
BINS, LOWEST, SPAN = 1 << 10, -1, 4
#: Rows with at least this score are predicted good.
LEAST_GOOD = 0.3
FOLDS, HELD_OUT, CALIBRATING = 5, 0, 1
AT_ONCE = 1 << 14


def _of_bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGITS = _of_bytes(bytes(range(65, 91))), _of_bytes(bytes(range(48, 58)))
STOPS, LOUD = _of_bytes(b".,;:"), _of_bytes(b"!?")
LETTERS = _of_bytes(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def log2(n: np.ndarray) -> np.ndarray:
    """About the logarithm of n + 1, in parts of ONE: straight lines between powers of two, which need no rounding of their own."""
    mantissa, exponent = np.frexp((n + 1).astype(np.float64))
    return ((2 * mantissa + exponent - 2) * ONE).astype(np.int64)


def distinct(part: Slice, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By document, how many different values begin at its words `starts`."""
    doc = part.doc_of_word()[starts]
    found = np.unique(mix(values[starts] + SPREAD * doc.astype(np.uint64)), return_index=True)[1]
    return np.bincount(doc[found], minlength=part.hi - part.lo)


def statistics(part: Slice) -> np.ndarray:
    """A row of whole numbers for each document of a slice."""
    words, points = np.diff(part.word_offsets), np.diff(part.point_offsets)
    begin, end = part.spans
    lengths = end - begin
    share = lambda n, of: n.astype(np.int64) * ONE // np.maximum(1, of)
    chars = lambda table: share(part.per_doc(table[part.buf], part.offsets), points)
    which = lambda flags: share(part.per_doc(flags, part.word_offsets), words)
    lines = part.per_doc(part.buf == 0x0A, part.offsets) + 1
    bytes_of = part.per_doc(part.is_word, part.offsets)
    has = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[part.buf])])[np.stack([begin, end])], axis=0)[0] > 0
    (pairs,) = windows(part.words, 2)
    inside = np.flatnonzero(part.inside(2, part.word_offsets)) if len(pairs) else np.zeros(0, np.int64)
    return np.column_stack([
        log2(words), log2(points), log2(lines), share(bytes_of, words),
        chars(SYMBOLS), chars(UPPER), chars(DIGITS), chars(STOPS), chars(LOUD), chars(SEPARATOR), chars(_of_bytes(bytes(range(0xC0, 256)))),
        which(has(SYMBOLS)), which(has(DIGITS)), which(~has(LETTERS)), which(UPPER[part.buf[begin]]), which(STOPS[part.buf[end - 1]]),
        which(lengths <= 3), which(lengths >= 12),
        share(distinct(part, part.words, np.arange(len(begin))), words), share(distinct(part, pairs, inside), words),
        share(repeated_lines(part), lines), share(repeated_words(part), words),
    ])


N = 22


@dataclass
class Features:
    """Standardised statistics as random Fourier features."""

    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    cosines: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> Features:
        rng = np.random.default_rng(seed)
        frequencies = np.rint(rng.normal(size=(len(mean), features)) / (2 * math.pi * width) * (TURN / UNIT))
        cosines = np.rint(np.cos(2 * math.pi * np.arange(STEPS) / STEPS) * AMPLITUDE)
        return cls(mean, deviation, frequencies, rng.integers(0, TURN, features), cosines)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """A row for each; the last feature is constant. Whole numbers, so small that their products add up exactly as doubles."""
        x = np.clip((stats - self.mean) * UNIT // self.deviation, -REACH * UNIT, REACH * UNIT)
        turned = (x.astype(np.float64) @ self.frequencies).astype(np.int64) + self.phases
        found = self.cosines[(turned // (TURN // STEPS)) % STEPS]
        return np.column_stack([found, np.full(len(stats), float(AMPLITUDE))])


@dataclass
class Model:
    features: Features | None
    weights: np.ndarray
    #: Predictions, and the probabilities there; between them straight lines.
    at: np.ndarray
    good: np.ndarray

    def predictions(self, stats: np.ndarray) -> np.ndarray:
        """In parts of AMPLITUDE * WEIGHT."""
        return self.features(stats) @ self.weights

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.good[0])
        out = [np.interp(self.predictions(stats[i : i + AT_ONCE]), self.at, self.good) for i in range(0, len(stats), AT_ONCE)]
        return np.concatenate(out) if out else np.zeros(0)


def matrix(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.int64) if len(c) else np.zeros((0, N), np.int64)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their statistics (`_stats`) instead of the text."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*map(column, kept), column(text).alias("_text"))

    def run(batches):
        for batch in (x for whole in batches for x in pieces_of(whole, "_text")):
            found = [np.zeros((0, N), np.int64), *(statistics(part) for part in slices(batch.column(batch.num_columns - 1)))]
            flat = pa.array(np.concatenate(found).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(flat, N).cast(pa.list_(pa.int64()))], [*kept, "_stats"])

    return rows.mapInArrow(run, widened(docs.select(*map(column, kept)).schema, "_stats array<long>"))


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows; mean and deviation of each statistic, as whole numbers from whole sums."""
    x = lambda i: F.col("_stats")[i].cast("decimal(38,0)")
    found = rows.agg(F.count(F.lit(1)), *[F.sum(x(i)) for i in range(N)], *[F.sum(x(i) * x(i)) for i in range(N)]).first()
    n = found[0]
    sums, squares = ([int(v or 0) for v in found[a : a + N]] for a in (1, N + 1))
    mean = [s // max(1, n) for s in sums]
    deviation = [max(1, math.isqrt(max(0, q // max(1, n) - m * m))) for q, m in zip(squares, mean, strict=True)]
    return n, np.array(mean, np.int64), np.array(deviation, np.int64)


def _normal_sums(shared):
    """A task's part of the normal equations: the products of features with features, and with the label, added up; one row a number."""

    def run(batches):
        upper, total = np.triu_indices(FEATURES + 1), None
        for batch in batches:
            stats, label = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for i in range(0, len(stats), AT_ONCE):
                f = shared.value(stats[i : i + AT_ONCE])
                own = np.concatenate([(f.T @ f)[upper], f.T @ label[i : i + AT_ONCE]]).astype(np.int64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "v"])

    return run


def _binned(shared):
    """A task's rows and good ones by bin of the prediction."""

    def run(batches):
        both = np.zeros((2, BINS * SPAN), np.int64)
        for batch in batches:
            stats, label = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, len(stats), AT_ONCE):
                at = np.clip(np.floor(shared.value.predictions(stats[i : i + AT_ONCE]) / (AMPLITUDE * WEIGHT / BINS)) - LOWEST * BINS, 0, BINS * SPAN - 1).astype(np.int64)
                both[0] += np.bincount(at, minlength=BINS * SPAN)
                both[1] += np.bincount(at[label[i : i + AT_ONCE] > 0], minlength=BINS * SPAN)
        found = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(both[0, found]), pa.array(both[1, found])], ["bin", "n", "ones"])

    return run


def isotonic(n: np.ndarray, ones: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Neighbouring bins pooled until shares of ones rise: (first, last, n, ones) of each pool. Shares are compared as products, without rounding."""
    pools: list[tuple[int, int, int, int]] = []
    for i, (a, b) in enumerate(zip(n.tolist(), ones.tolist(), strict=True)):
        pool = (i, i, a, b)
        while pools and pools[-1][3] * pool[2] >= pool[3] * pools[-1][2]:
            first, _, m, k = pools.pop()
            pool = (first, pool[1], m + pool[2], k + pool[3])
        pools.append(pool)
    return pools


def fit_quality(stats: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """A model of the rows (doc_id, _stats) that have a label in (doc_id, quality), 0 or 1; `where` restricts doc_ids.

    All of them count. An id with several labels is good if one of them is; a label is every row's
    of its id. Rows of fold 1 of 5 calibrate, the others fit; without both classes in that fold the others
    calibrate too. With one class only, all scores are its label; without labels they are 0.5. The driver
    holds a number for each pair of features, whatever the rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known if where is None else known.where(where)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
    rows = settled(stats.select("doc_id", "_stats").join(known, "doc_id").select("_stats", "_label", (fold() == CALIBRATING).alias("_calibrates")))
    sizes = {(r["_label"], r["_calibrates"]): r["n"] for r in rows.groupBy("_label", "_calibrates").agg(F.count("*").alias("n")).collect()}
    ones, total = sum(n for (label, _), n in sizes.items() if label), sum(sizes.values())
    if ones in (0, total):
        return Model(None, np.zeros(0), np.zeros(1), np.array([ones / total if total else 0.5]))
    apart = all((label, c) in sizes for label in (0, 1) for c in (False, True))
    fitting, calibrating = (rows.where(~F.col("_calibrates")), rows.where("_calibrates")) if apart else (rows, rows)
    n, mean, deviation = _moments(fitting)
    features = Features.of(mean, deviation)
    context = stats.sparkSession.sparkContext
    shared = context.broadcast(features)
    sums = fitting.select("_stats", "_label").mapInArrow(_normal_sums(shared), "slot int, v long").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(len(sums))
    for r in sums:
        values[r["slot"]] = r["v"]
    width = FEATURES + 1
    upper, a = np.triu_indices(width), np.zeros((width, width))
    a[upper] = values[: len(upper[0])]
    a = (a + np.triu(a, 1).T) / (float(AMPLITUDE) ** 2 * n)
    b = values[len(upper[0]) :] / (float(AMPLITUDE) * n)
    weights = np.rint(np.linalg.solve(a + PENALTY * np.eye(width), b) * WEIGHT)
    model = Model(features, weights, np.zeros(0), np.zeros(0))
    held = context.broadcast(model)
    bins = calibrating.select("_stats", "_label").mapInArrow(_binned(held), "bin int, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()
    at = np.array([r["bin"] for r in bins])
    pools = isotonic(np.array([r["n"] for r in bins]), np.array([r["ones"] for r in bins]))
    middle = np.array([(at[first] + at[last] + 1) / 2 for first, last, _, _ in pools])
    return Model(features, weights, (middle / BINS + LOWEST) * AMPLITUDE * WEIGHT, np.array([k / m for _, _, m, k in pools]))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def score(stats: DataFrame, model: Model) -> DataFrame:
    """The rows of `with_statistics` with score and predicted instead of the statistics."""
    kept = [c for c in stats.columns if c != "_stats" and c.lower() not in ("score", "predicted")]
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value(matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= LEAST_GOOD).astype(np.int32))], [*kept, "score", "predicted"])

    rows = stats.select(*map(column, kept), "_stats")
    return rows.mapInArrow(run, widened(rows.drop("_stats").schema, "score double, predicted int"))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1, probability of good quality) and predicted (1 from LEAST_GOOD on).

    A null text counts as an empty one, whose statistics are zero and which is scored as any other. Texts of any length are
    read whole. Repeated rows are scored one by one, and alike. Other columns stay, but score and predicted, in any case of letters, are
    replaced. A score of exactly LEAST_GOOD is predicted 1. An empty table gives no rows.
    """
    return score(with_statistics(docs, text), model)


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = settled(with_statistics(docs))
    model = fit_quality(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != HELD_OUT)
    return score(stats, model).select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
