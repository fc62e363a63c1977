"""Does a key repeat? Asked of targets that enforce nothing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quoted


def _ends(batches):
    """A task's least and greatest key, how often a key equals the one before, and whether keys never fall."""
    first = last = None
    repeats, rising = 0, True
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        repeats += int((k[1:] == k[:-1]).sum()) + int(last is not None and k[0] == last)
        rising &= bool((k[1:] >= k[:-1]).all()) and (last is None or k[0] >= last)
        first, last = k[0] if first is None else first, k[-1]
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"low": int(first), "high": int(last), "repeats": repeats, "rising": rising}], pa.schema({"low": pa.int64(), "high": pa.int64(), "repeats": pa.int64(), "rising": pa.bool_()}))


def repeated_keys(rows: DataFrame, key: str) -> int:
    """How many rows have a key that another row has already: rows less different keys.

    Only the key is read. Where tasks' keys rise and tasks don't overlap, as in files that were written in the key's order,
    neighbours are compared, and tasks' ends with each other, a row a task; nothing is shuffled. Any other rows are counted
    by key, with partial counts first.
    """
    k = rows.select(F.col(quoted(key)).alias("k")).where(F.col("k").isNotNull())
    if k.schema["k"].dataType.typeName() in ("byte", "short", "integer", "long"):
        ends = sorted((r["low"], r["high"], r["repeats"], r["rising"]) for r in k.select(F.col("k").cast("long")).mapInArrow(_ends, "low long, high long, repeats long, rising boolean").collect())
        apart = all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
        if apart and all(e[3] for e in ends):
            return sum(e[2] for e in ends) + sum(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    return int(k.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0])
