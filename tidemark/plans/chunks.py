"""Chunks: inclusive intervals of key values, and waves: runs of chunks that one Spark job copies.

Bounds are Python integers on the driver, so keys near the ends of 64 bits don't overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import whole
from ..model import Chunk, KeyRange, SourceFile, Wave


def first_key(keys: KeyRange, last_pk: int | None) -> int:
    """Where copying begins after `last_pk` is committed."""
    return keys.low if last_pk is None else max(last_pk + 1, keys.low)


def n_chunks(start: int, high: int, size: int) -> int:
    return max(0, -(-(high - start + 1) // size))


def chunks(start: int, high: int, size: int) -> Iterator[Chunk]:
    """All chunks from start to high, in order; made one at a time, as sparse keys can have very many."""
    if size < 1:
        raise ValueError("a chunk needs at least one key value")
    while start <= high:
        yield Chunk(start, min(start + size - 1, high))
        start += size


def waves(start: int, high: int, size: int, count: int) -> list[Chunk]:
    """At most `count` waves of whole chunks, of like width, covering start to high."""
    per = max(1, -(-n_chunks(start, high, size) // count))
    return list(chunks(start, high, per * size))


def balanced(span: Chunk, rows_each: int, most: int, histogram: Callable[[Chunk, int], dict[int, int]]) -> list[Chunk]:
    """Intervals that cover the span, with about `rows_each` rows or, if these would be more than `most` intervals, as many more.

    `histogram(span, width)` counts a span's rows by intervals of a width, from its start on. Intervals with more than a
    quarter of the rows wanted are counted again in finer ones, down to single keys, so neither gaps nor outliers matter: only
    a single key's rows stay together. Few of these counts are needed, as the first has 16 intervals for each one wanted.
    """
    fine = 1 << 12
    halves = [span] if span.end - span.start < 1 << 62 else [Chunk(a, min(a + (1 << 62) - 1, span.end)) for a in range(span.start, span.end + 1, 1 << 62)]
    cells = [(c.start, c.end, n) for c in halves for n in histogram(c, 1 << 62).values()]
    each = max(1, rows_each, -(-sum(n for _, _, n in cells) // most))
    done: list[tuple[int, int, int]] = []
    while cells:
        start, end, n = cells.pop()
        if start == end or 4 * n <= each:
            done.append((start, end, n))
            continue
        width = -(-(end - start + 1) // min(1 << 16, max(fine, 16 * -(-n // each))))
        cells += [(start + i * width, min(start + (i + 1) * width - 1, end), k) for i, k in histogram(Chunk(start, end), width).items()]
    done.sort()
    left, starts, now = sum(n for _, _, n in done), [], 0
    share = left / max(1, -(-left // each))
    for start, _, n in done:
        if not starts or now + n / 2 > share:
            parts = max(1, round((left - now) / each))
            left, now, share = left - now, 0, (left - now) / parts
            starts.append(start)
        now += n
    starts = [span.start, *starts[1:]]
    return [Chunk(a, b - 1) for a, b in zip(starts, [*starts[1:], span.end + 1], strict=True)]


def grouped(parts: Sequence[Chunk], count: int) -> list[Wave]:
    """At most `count` waves of neighbouring parts, as many in each as can be."""
    each = max(1, -(-len(parts) // count))
    return [Wave(own[0].start, own[-1].end, tuple(own)) for own in (parts[i : i + each] for i in range(0, len(parts), each))]


def file_waves(files: Sequence[SourceFile], count: int) -> list[list[SourceFile]]:
    """At most `count` runs of neighbouring files, of like numbers of bytes."""
    total, out, before = sum(f.bytes for f in files), [], 0
    for f in files:
        number = min(count - 1, before * count // max(1, total))
        if not out or number > last:
            out.append([])
            last = number
        out[-1].append(f)
        before += f.bytes
    return out


def chunk_of(key: Column, low: int, size: int) -> Column:
    """Number of the chunk of a key that isn't below `low`, as a decimal: exact for any whole keys."""
    wide = "decimal(38,0)"
    shifted, width = key.cast(wide) - whole(low).cast(wide), whole(size).cast("decimal(20,0)")
    return ((shifted - shifted % width) / width).cast(wide)


def chunk_frame(spark: SparkSession, start: int, high: int, size: int) -> DataFrame:
    """The chunks as rows chunk_id, chunk_start, chunk_end, made on the executors."""
    rows = spark.range(n_chunks(start, high, size)).withColumnRenamed("id", "chunk_id")
    at = F.lit(start) + F.col("chunk_id") * size
    return rows.select("chunk_id", at.alias("chunk_start"), F.least(at + (size - 1), F.lit(high)).cast("long").alias("chunk_end"))
