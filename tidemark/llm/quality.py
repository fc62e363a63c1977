"""Operator 4: quality rules.

Exact counts of every whole text (words, symbols, repeated lines, repeated 8-word windows)
give the fixed base rules. A logistic regression over hashed word and character n-grams,
fitted on the labelled quality rows and calibrated on a fold it wasn't fitted on, judges
what the base rules leave. Texts are scored in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import linear
from .shared import carried, restored, widened
from .textops import Slice, hash_spans, mix, point_grams, slices, windows

#: The base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: n-grams of the classifier, each kind in its own 2**BITS buckets.
WORD_GRAMS, CHAR_GRAMS, BITS = (1, 2), (3, 4), 11
KINDS = len(WORD_GRAMS) + len(CHAR_GRAMS)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Documents whose probability of good quality is less are rejected.
LEAST_GOOD = 0.2


def repeated_words(part: Slice, size: int = WINDOW) -> np.ndarray:
    """Of each document, the words in windows that occur twice or more in it."""
    (found,) = windows(part.words, size)
    out = np.zeros(part.hi - part.lo, np.int64)
    if not len(found):
        return out
    starts = np.flatnonzero(part.inside(size, part.word_offsets))
    keys = mix(found[starts] + SPREAD * part.doc_of_word()[starts].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return out
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(part.words) + 1, np.int64)
    change[starts[twice]] += 1
    change[starts[twice] + size] -= 1
    return part.per_doc(np.cumsum(change[:-1]) > 0, part.word_offsets)


def repeated_lines(part: Slice) -> np.ndarray:
    """Of each document, the lines with a word that equal an earlier line of it."""
    n = len(part.buf)
    if not n:
        return np.zeros(part.hi - part.lo, np.int64)
    cuts = np.flatnonzero(part.buf == 0x0A)
    starts = np.union1d(cuts + 1, part.offsets[:-1])
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ends = ends - (part.buf[ends - 1] == 0x0A)
    full = np.searchsorted(part.spans[0], ends) > np.searchsorted(part.spans[0], starts)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(part.offsets, starts, "right") - 1
    keys = mix(hash_spans(part.buf, starts, ends) + SPREAD * doc.astype(np.uint64))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return np.bincount(doc[again], minlength=part.hi - part.lo)


def counts(part: Slice) -> dict[str, np.ndarray]:
    points = part.is_word & ((part.buf & 0xC0) != 0x80)
    return {
        "n_words": np.diff(part.word_offsets),
        "word_chars": part.per_doc(points, part.offsets),
        "n_symbols": part.per_doc(SYMBOLS[part.buf], part.offsets),
        "n_dup_lines": repeated_lines(part),
        "n_repeat_words": repeated_words(part),
    }


def failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def buckets(part: Slice):
    """For each kind of n-gram: bucket of every n-gram, bounds of the documents, n."""
    grams = [(x, part.word_offsets, n) for x, n in zip(windows(part.words, *WORD_GRAMS), WORD_GRAMS, strict=True)]
    grams += [(x, part.point_offsets, n) for x, n in zip(point_grams(part.points(), CHAR_GRAMS), CHAR_GRAMS, strict=True)]
    for kind, (hashed, bounds, n) in enumerate(grams):
        yield ((hashed * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS), bounds, n


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def good(self, part: Slice) -> np.ndarray:
        """Probability of good quality, by document."""
        z = np.full(part.hi - part.lo, self.intercept)
        for ids, bounds, n in buckets(part):
            z += part.per_doc(self.weights[ids], bounds, n - 1) / np.maximum(1, np.diff(bounds) - n + 1)
        return linear.sigmoid(self.slope * z + self.shift)


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Shares of the n-gram buckets, by document: at most as many as there are buckets, however long the text."""
    ids, values = [], []
    for part in slices(texts):
        own: list[list] = [[] for _ in range(part.hi - part.lo)]
        for all_ids, bounds, n in buckets(part):
            for d in range(part.hi - part.lo):
                found, times = np.unique(all_ids[bounds[d] : max(bounds[d], bounds[d + 1] - n + 1)], return_counts=True)
                own[d].append((found.astype(np.uint16), (times / max(1, bounds[d + 1] - bounds[d] - n + 1)).astype(np.float32)))
        ids += [np.concatenate([x for x, _ in d]) for d in own]
        values += [np.concatenate([x for _, x in d]) for d in own]
    return ids, values


def _emit_features(batches):
    for batch in batches:
        ids, values = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())], ["doc_id", "label", "ids", "values"])


def train(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Model | None:
    """Fit on four fifths, calibrate on the rest. None if a class is missing: then nothing is rejected."""
    if len(set(y.tolist())) < 2:
        return None
    width, scale = KINDS << BITS, np.float32(300.0)
    held = np.arange(len(y)) % 5 == 4
    pick = lambda at: linear.Rows([ids[i] for i in np.flatnonzero(at)], np.full(width, scale), [values[i] for i in np.flatnonzero(at)])
    w, b = linear.fit(pick(~held), y[~held], penalty=1e-5, steps=80, rate=0.03)
    both = held.any() and len(set(y[held].tolist())) == 2
    slope, shift = linear.platt(pick(held).dot(w) + b, y[held]) if both else (1.0, 0.0)
    return Model((w * scale).astype(np.float32), b, slope, shift)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000) -> Model | None:
    """A model from `sample_rows` labelled rows at most (quality 1: good).

    The driver holds six bytes for each bucket that a row's text has, 98 MB at most, whatever the texts.
    """
    rows = linear.labelled(docs, labels, "quality", sample_rows).mapInArrow(_emit_features, "doc_id long, label double, ids binary, values binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["ids"]))
    return train([np.frombuffer(r["ids"], np.uint16) for r in rows], [np.frombuffer(r["values"], np.float32) for r in rows], np.array([r["label"] for r in rows]))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, good double, kept boolean"


def _judged(docs: DataFrame, model: Model | None, least_good: float, text: str) -> DataFrame:
    """The text, the other columns of docs in `_own`, and the added columns."""
    added = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    rows = docs.select(*carried(docs, text)).withColumnRenamed(text, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            for part in slices(batch.column("_text")):
                cols = {k: v.astype(np.int64) for k, v in counts(part).items()}
                cols["base_failed"] = failed(cols["n_words"], cols["n_repeat_words"])
                cols["good"] = shared.value.good(part) if shared.value else np.ones(part.hi - part.lo)
                cols["kept"] = ~cols["base_failed"] & (cols["good"] >= least_good)
                own = batch.slice(part.lo, part.hi - part.lo)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(cols[k]) for k in added)], [*own.schema.names, *added])

    return rows.mapInArrow(score, widened(StructType(rows.schema.fields), COLUMNS))


def judge(docs: DataFrame, model: Model | None, least_good: float = LEAST_GOOD, text: str = "text") -> DataFrame:
    """Every row of docs with the counts, base_failed, good (probability) and kept.

    A null or empty text has no words, so it fails the base rules. Whole texts of any length
    count; a very long one is held in one task. Columns of docs that clash with the added
    ones, in any case of letters, are replaced. Repeated rows are judged one by one; a
    probability of exactly `least_good` is kept.
    """
    added = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    docs = docs.drop(*added)
    return _judged(docs, model, least_good, text).select(*restored(docs, **{text: F.col("_text")}), *added)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model).drop("text")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns as they are, whatever their names."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, model, LEAST_GOOD, "text").where("kept").select(*restored(docs, text=F.col("_text")))
