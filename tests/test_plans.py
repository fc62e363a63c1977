import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import percent, quoted, rate
from tidemark.model import Chunk, KeyRange
from tidemark.plans import chunk_frame, chunk_of, chunks, first_key, n_chunks, waves


def test_chunks_cover_the_range_once():
    rng = random.Random(3)
    for _ in range(300):
        low, size = rng.randint(-1000, 1000), rng.randint(1, 400)
        high = low + rng.randint(0, 3000)
        last = rng.choice([None, low - 5, low, rng.randint(low, high), high])
        start = first_key(KeyRange(low, high), last)
        plan = list(chunks(start, high, size))
        assert len(plan) == n_chunks(start, high, size)
        assert [k for c in plan for k in range(c.start, c.end + 1)] == list(range(start, high + 1))
        for count in (1, 3, 7):
            runs = waves(start, high, size, count)
            assert len(runs) <= count
            assert [k for c in runs for k in (c.start, c.end)] == sorted(k for c in runs for k in (c.start, c.end))
            assert {c.start for c in runs} <= {c.start for c in plan}
            assert not plan or (runs[0].start, runs[-1].end) == (start, high)


def test_chunks_refuse_no_width_and_make_none_when_done():
    with pytest.raises(ValueError):
        next(chunks(0, 5, 0))
    assert list(chunks(6, 5, 10)) == []


def test_chunks_at_the_ends_of_64_bits():
    low, high = -(2**63), 2**63 - 1
    plan = waves(low, high, 50_000, 4)
    assert plan[0].start == low and plan[-1].end == high and len(plan) == 4
    near = list(chunks(high - 3, high, 3))
    assert near == [Chunk(high - 3, high - 1), Chunk(high, high)]


def test_chunk_of_matches_integers(spark):
    low, high = -(2**63), 2**63 - 1
    rows = spark.createDataFrame([(low,), (-1,), (0,), (high,)], "k long")
    for at, size in ((low, 50_000), (low, 2**62), (low, 1)):
        got = {r.k: int(r.c) for r in rows.select("k", chunk_of(F.col("k"), at, size).alias("c")).collect()}
        assert got == {k: (k - at) // size for k in (low, -1, 0, high)}


def test_chunk_frame(spark):
    assert [tuple(r) for r in chunk_frame(spark, 0, 14999, 4000).orderBy("chunk_id").collect()] == [(0, 0, 3999), (1, 4000, 7999), (2, 8000, 11999), (3, 12000, 14999)]


def test_guards(spark):
    row = spark.createDataFrame([(5, 10, 2.0), (5, 0, 0.0)], "a long, b long, s double").select(percent(F.col("a"), F.col("b")), rate(F.col("a"), F.col("s"))).collect()
    assert [tuple(r) for r in row] == [(50.0, 2.5), (0.0, 0.0)]
    assert quoted("a`b") == "`a``b`"
