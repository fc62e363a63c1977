"""Operator 1: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Blocks of vectors post these in
inverted files, one list a pivot with the vector's place for it; a query adds up over the
lists of its own pivots how near the places are, which gives the footrule distance of the two
orders. Vectors are ranked by it, and in this order ranked again by their exact cosine. A
share of further vectors must bring nothing before a query leaves a block, so a group of near copies,
whose orders are nearly the same, is gone through as far as it brings nearer ones.

Every vector is indexed, in a block of bounded size. Queries meet blocks in tasks of a
block of queries and a block of vectors; each sends its few best on.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS, ORDER = 256, 64
#: So many further vectors, as a share of a block's distinct ones and at least, must bring nothing before the ranking ends.
STOP, LEAST = 0.14, 200
BLOCK, QUERY_BLOCK = 8192, 4096


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def orders(v: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, in order."""
    return np.argsort(-(unit(v) @ pivots.T), 1, kind="stable")[:, :length].astype(np.int16)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of one vector with each of others; equal vectors get equal values, whatever stands beside them."""
    qs, vs = q / np.abs(q).max(), v / np.abs(v).max(1, keepdims=True)
    return np.clip((vs * qs).sum(1) / np.sqrt((vs * vs).sum(1) * (qs * qs).sum()), -1.0, 1.0)


class InvertedFiles:
    """The lists of a block: by pivot, the vectors that have it among their nearest, and its place."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.length = order.shape
        self.most = self.length * (self.length + 1) // 2  # the agreement of equal orders
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.places = (by // self.length).astype(np.int32), (by % self.length).astype(np.int16)
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))

    def agreement(self, query: np.ndarray) -> np.ndarray:
        """What the footrule distance of each vector falls short of its maximum, halved."""
        score = np.zeros(self.n, np.int32)
        for place, p in enumerate(query.tolist()):
            at = slice(self.bounds[p], self.bounds[p + 1])
            score[self.rows[at]] += self.length - np.maximum(self.places[at], place)
        return score


def search_block(queries: pa.Table, block: pa.Table, pivots: int, k: int) -> pa.Table:
    """Each query's k best of a block, by way of the block's inverted files.

    Vectors are ranked by footrule, all those of one distance together, and their cosines are worked out in
    this order, until STOP more in a row bring none among the k best.
    """
    ids, v, order = block.column("vec_id").to_numpy(), matrix(block.column("v")), matrix(block.column("p")).astype(np.int16)
    out: tuple[list, list, list] = ([], [], [])
    if len(ids) and len(queries):
        by = np.argsort(ids, kind="stable")
        ids, v, order = ids[by], v[by], order[by]
        _, first, kind = np.unique(v, axis=0, return_index=True, return_inverse=True)  # equal vectors share a place in the lists
        kind = kind.ravel()
        members = np.argsort(kind, kind="stable")
        starts = np.searchsorted(kind[members], np.arange(len(first) + 1))
        files, kinds, step = InvertedFiles(order[first], pivots), v[first], max(LEAST, math.ceil(STOP * len(first)))
        for q, x, p in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("v")), matrix(queries.column("p")).astype(np.int16), strict=True):
            score = files.agreement(p)
            at_least = np.cumsum(np.bincount(score, minlength=files.most + 1)[::-1])[::-1]  # vectors by score, that one and better
            best, near, cut, done = np.zeros(0, np.int64), np.zeros(0), -2.0, files.most + 1
            while done > 0:
                goal = (at_least[done] if done <= files.most else 0) + step
                down = max(0, int(np.searchsorted(-at_least, -goal, "right")) - 1)  # the best score with so many
                found = np.flatnonzero((score >= down) & (score < done))
                got = cosines(x, kinds[found]) if len(found) else near[:0]
                done, better = down, len(near) <= k or bool((got > cut).any())
                keep = got >= cut
                best, near = np.append(best, found[keep]), np.append(near, got[keep])
                cut = np.sort(near)[-(k + 1)] if len(near) > k else -2.0
                if not better:
                    break
            rows = []
            for c, s in zip(best[near >= cut], near[near >= cut], strict=True):
                same = np.unique(ids[members[starts[c] : starts[c + 1]]])
                rows += [(-s, i) for i in same[: k + 1].tolist() if i != q]
            for s, i in sorted(rows)[:k]:
                out[0].append(q)
                out[1].append(i)
                out[2].append(-s)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, order: int = ORDER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query by cosine, as far as the index finds them (README has the recall).

    is_query is a condition on vec_id. Rows without an id, and vectors that are null, empty, zero or not
    finite take no part. Cosines are between vectors of one dimension, so each dimension is searched by
    itself, with jobs of its own, and where nothing else has a query's dimension it finds nothing.
    Repeated rows count once. An id with several vectors asks with the least of them, never finds
    itself, and is found with each; ties go to the smaller vec_id. An empty table gives no rows.
    """
    rows = usable(vectors, id, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).orderBy("d").collect()
    of = [_of_dimension(rows.where(F.size("v") == r["d"]), is_query, k, pivots, order, r["n"], r["asked"]) for r in sizes if r["asked"]]
    return functools.reduce(DataFrame.union, of) if of else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_dimension(rows: DataFrame, is_query, k: int, pivots: int, order: int, n_rows: int, n_queries: int) -> DataFrame:
    """The search among vectors of one dimension.

    Pivots are the vectors with the smallest hash of their id, `pivots` at most; that bounded sample
    is all that the driver holds. Copies of a row meet before blocks are dealt, so no id makes a block large.
    """
    chosen = unit(np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()]))
    length, n_pivots = min(order, len(chosen)), len(chosen)

    def permute(batches):
        for batch in batches:
            p = orders(matrix(batch.column("v")), chosen, length) if batch.num_rows else np.zeros((0, length), np.int16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), length).cast(pa.list_(pa.int16()))], ["vec_id", "v", "p"])

    schema = "vec_id long, v array<double>, p array<short>"
    blocks, query_blocks = max(1, math.ceil(n_rows / BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    deal = lambda n, name, *of: F.pmod(F.xxhash64(*of), F.lit(n)).alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(permute, schema).select("*", deal(query_blocks, "a", "vec_id")).select("*", every(blocks, "b"))
    held = rows.distinct().mapInArrow(permute, schema).select("*", deal(blocks, "b", "vec_id", "v")).select("*", every(query_blocks, "a"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, n_pivots, k)

    found = asked.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
