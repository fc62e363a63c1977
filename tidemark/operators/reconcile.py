"""Comparing two tables as bags of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..functions import quoted


def exact(c: Column, kind: DataType) -> Column:
    """A form of the value that tells -0.0 from 0.0 and that maps have too."""
    if isinstance(kind, DoubleType | FloatType):
        return c.cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: exact(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(exact(e["key"], kind.keyType).alias("key"), exact(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[exact(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: source_rows, target_rows, missing_rows (only in source), extra_rows (only in target).

    Rows are counted by value on either side; one shuffle of partial counts, no pairs.
    """
    kinds = source.schema
    rows = [df.select(*[exact(F.col(quoted(f.name)), f.dataType).alias(f"c{i}") for i, f in enumerate(kinds)], F.lit(n).alias("n")) for df, n in ((source, 1), (target, -1))]
    columns = [f"c{i}" for i in range(len(kinds))]
    counted = reduce(DataFrame.union, rows).groupBy(*columns).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("s"), F.sum(F.when(F.col("n") < 0, 1).otherwise(0)).alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counted.agg(total(F.col("s")).alias("source_rows"), total(F.col("t")).alias("target_rows"), total(F.greatest(F.col("s") - F.col("t"), F.lit(0))).alias("missing_rows"), total(F.greatest(F.col("t") - F.col("s"), F.lit(0))).alias("extra_rows"))
