"""Operator 10: toxicity.

Character n-grams of the lower-cased text, each counted once a document and scaled by its
naive Bayes log-count ratio, in a logistic regression trained on labelled rows. n-grams
are hashed; those of few documents or a ratio near zero are left out, so that what a long
clean text happens to hold adds up to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .shared import settled, widened
from .textops import SEPARATOR, as_text, pieces_of, point_grams, slices

#: Lengths in characters of the n-grams; any white space counts as one character, so that they see where words begin.
GRAMS, BITS = (3, 4, 5, 6, 7, 8), 21
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: A feature needs so many documents of the sample, and so large a log-count ratio.
LEAST_DOCS, LEAST_RATIO = 5, 2.5
#: Features at most: those with the largest ratios; a parameter of the model, as LEAST_DOCS is (sf0.1 has 2,688). Tasks that count the sample, which is small.
MOST_FEATURES, TASKS = 1 << 14, 4
#: Rows with at least this score are predicted toxic.
LEAST_TOXIC = 0.3
FOLDS, HELD_OUT = 4, 2
_BLANK = np.where(SEPARATOR, 0x20, np.arange(256)).astype(np.uint8)


def buckets(texts: pa.Array):
    """For every slice of the texts: its documents, and by n the bucket of every n-gram of characters."""
    for part in slices(pc.utf8_lower(as_text(texts))):
        grams = point_grams(part.points(_BLANK[part.buf]), GRAMS)
        yield part, [((x * SPREAD) >> np.uint64(64 - BITS)).astype(np.int32) for x in grams]


def spans(part, d: int):
    """Where the n-grams of document d begin and end among a slice's, by n."""
    lo, hi = part.point_offsets[d], part.point_offsets[d + 1]
    return [slice(lo, max(lo, hi - n + 1)) for n in GRAMS]


@dataclass
class Model:
    """weights: by bucket, the regression's weight times the log-count ratio; 0 if not a feature."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out, used = [np.zeros(0)], self.weights != 0
        for part, grams in buckets(texts):
            z = np.full(part.hi - part.lo, self.intercept)
            hits = [(at, ids[at]) for ids in grams for at in [np.flatnonzero(used[ids])]]
            doc = np.concatenate([np.searchsorted(part.point_offsets, at, "right") - 1 for at, _ in hits])
            end = np.concatenate([at + n for (at, _), n in zip(hits, GRAMS, strict=True)])
            ids = np.concatenate([x for _, x in hits])
            inside = end <= part.point_offsets[doc + 1]
            key = np.unique((doc[inside].astype(np.int64) << BITS) | ids[inside])
            z += np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], part.hi - part.lo)
            out.append(linear.sigmoid(self.slope * z + self.shift))
        return np.concatenate(out)


def _emit_counts(batches):
    """Documents of either label that hold a bucket, of this task's part of the sample."""
    both = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        labels = batch.column("label").to_numpy().astype(int)
        for part, grams in buckets(batch.column("text")):
            for d in range(part.hi - part.lo):
                both[labels[part.lo + d], np.unique(np.concatenate([ids[at] for ids, at in zip(grams, spans(part, d), strict=True)]))] += 1
    found = np.flatnonzero(both.any(0))
    for i in range(0, len(found), 1 << 18):
        x = found[i : i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(both[0, x].astype(np.int64)), pa.array(both[1, x].astype(np.int64))], ["bucket", "clean", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, where=None) -> Model | None:
    """A model from `sample_rows` labelled rows at most. None if a class is missing: then scores are 0.

    The driver holds two bytes for each feature that a row has, 200 MB at most, whatever the texts.
    """
    sample = settled(linear.labelled(docs, labels, "toxic", sample_rows, where).coalesce(TASKS))
    sizes = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rows = sample.mapInArrow(_emit_counts, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    ratio = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    kept = rows.withColumn("ratio", ratio).where(F.abs("ratio") >= LEAST_RATIO).orderBy(F.desc(F.abs("ratio")), "bucket").limit(MOST_FEATURES).toPandas()
    column = np.full(1 << BITS, -1, np.int32)
    column[kept["bucket"].to_numpy()] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def emit_rows(batches):
        for batch in batches:
            own = []
            for part, grams in buckets(batch.column("text")):
                for d in range(part.hi - part.lo):
                    x = np.unique(shared.value[np.concatenate([ids[at] for ids, at in zip(grams, spans(part, d), strict=True)])])
                    own.append(x[x >= 0].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "ids"])

    rows = sorted(sample.mapInArrow(emit_rows, "doc_id long, label double, ids binary").collect(), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["ids"]))
    ids, y, ratios = [np.frombuffer(r["ids"], np.uint16) for r in rows], np.array([r["label"] for r in rows]), kept["ratio"].to_numpy(np.float64)
    held = np.arange(len(y)) % 5 == 4
    pick = lambda at: linear.Rows([ids[i] for i in np.flatnonzero(at)], ratios)
    w, b = linear.fit(pick(~held), y[~held], penalty=1e-3, steps=150, rate=0.02)
    slope, shift = linear.platt(pick(held).dot(w) + b, y[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept["bucket"].to_numpy()] = w * ratios
    return Model(weights, b, slope, shift)


def held_out():
    """Is the row of the fold that no model learns from?"""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from LEAST_TOXIC on).

    A null or empty text has no features, so it gets the score of the intercept; all others
    are scored whole, whatever their length. Columns of docs named score or predicted, in any
    case of letters, are replaced; repeated rows are scored one by one; a score of exactly
    LEAST_TOXIC is predicted 1.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in (rows for whole in batches for rows in pieces_of(whole, text)):
            texts = batch.column(batch.schema.get_field_index(text))
            s = shared.value(texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= LEAST_TOXIC).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, widened(docs.schema, "score double, predicted int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
