"""Is a target what its source is? Sums of row hashes by part of the table; rows are compared only where these differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import quoted, whole
from ..model import Comparison
from ..plans import chunk_of
from .reconcile import exact, reconcile
from .scan import key_range, usable_key

#: Parts of a table that are told apart, at most; their sums come to the driver.
MOST_PARTS = 4096
#: Parts of a table without a key: by this many low bits of a row's hash.
UNKEYED_BITS = 8
#: The seeds of the two hashes of a row.
SEEDS = (0x7469_6465, 0x6D61_726B)


def _marked(c: Column, kind: DataType) -> Column:
    """A form that hashes apart what Spark's hash takes for the same: nulls are skipped there, and arrays have no ends."""
    if isinstance(kind, ArrayType):
        return F.struct(F.coalesce(F.size(c), F.lit(-1)).alias("size"), F.transform(c, lambda x: _marked(x, kind.elementType)).alias("of"))
    if isinstance(kind, StructType):
        return F.struct(c.isNull().alias("none"), *[_marked(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind)])
    return F.struct(c.isNull().alias("none"), c.alias("value"))


def _hashed(rows: DataFrame) -> DataFrame:
    """rows with h0 and h1, 128 bits over all columns in their order."""
    own = [exact(F.col(f.name), f.dataType) for f in rows.schema]
    kinds = rows.select(*[c.alias(n) for c, n in zip(own, rows.columns, strict=True)]).schema
    marked = [_marked(c, form.dataType) for c, form in zip(own, kinds, strict=True)]
    return rows.select("*", *[F.xxhash64(F.lit(seed), *marked).alias(f"h{i}") for i, seed in enumerate(SEEDS)])


def _sums() -> list[Column]:
    """The sum of each of six pieces of the 128 bits: of 22 bits at most, so 64 bits hold the sums of 2**41 rows."""
    pieces = [F.shiftrightunsigned(f"h{h}", at).bitwiseAND(F.lit((1 << 22) - 1).cast("long")) for h in (0, 1) for at in (0, 22, 44)]
    return [F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)]


class _Parts:
    """How two tables are cut: by intervals of the key, whose width is a power of two, or else by the rows' hashes."""

    def __init__(self, source: DataFrame, target: DataFrame, key: str | None):
        self.key = key if key is not None and usable_key(source.schema[key].dataType) else None
        self.low = self.bits = 0
        if self.key is None:
            return
        ranges = [r for r in (key_range(df, key) for df in (source, target)) if r.rows > r.nulls]
        self.low, high = min((r.low for r in ranges), default=0), max((r.high for r in ranges), default=0)
        self.bits = max(0, (high - self.low).bit_length() - (MOST_PARTS.bit_length() - 1))
        self.narrow = high - self.low < 1 << 63 and -(1 << 63) <= self.low and high < 1 << 63

    def number(self) -> Column:
        """A row's part; -1 for rows without a key."""
        if self.key is None:
            return F.col("h0").bitwiseAND(F.lit((1 << UNKEYED_BITS) - 1).cast("long"))
        k = F.col(self.key)
        part = F.shiftright(k.cast("long") - whole(self.low), self.bits) if self.narrow else chunk_of(k, self.low, 1 << self.bits).cast("long")
        return F.coalesce(part, F.lit(-1).cast("long"))

    def bounds(self, part: int) -> tuple[int | None, int | None]:
        """The part's first and last key."""
        first = self.low + (part << self.bits)
        return (None, None) if self.key is None or part < 0 else (first, first + (1 << self.bits) - 1)

    def within(self, rows: DataFrame, numbers: list[int]) -> DataFrame:
        """The rows of these parts; where all have keys, the scan is told the interval from the first to the last part."""
        if self.key is not None and min(numbers) >= 0:
            rows = rows.where(F.col(self.key).between(whole(self.bounds(min(numbers))[0]), whole(self.bounds(max(numbers))[1])))
        few = rows.sparkSession.createDataFrame([(n,) for n in numbers], "part long")  # MOST_PARTS + 1 at most
        return rows.withColumn("part", self.number()).join(F.broadcast(few), "part", "left_semi").drop("part")


def part_sums(source: DataFrame, target: DataFrame, parts: _Parts) -> DataFrame:
    """part, source_rows, target_rows, same. What is shuffled is a row for each part from each task."""
    sides = []
    for df, side in ((source, "source"), (target, "target")):
        sums = _hashed(df).groupBy(parts.number().alias("part")).agg(F.count(F.lit(1)).alias("n"), *_sums())
        sides.append(sums.select("part", F.struct("n", *[f"s{i}" for i in range(6)]).alias(side)))
    both = sides[0].join(sides[1], "part", "full_outer")
    rows = lambda side: F.coalesce(F.col(f"{side}.n"), F.lit(0)).alias(f"{side}_rows")
    return both.select("part", rows("source"), rows("target"), F.col("source").eqNullSafe(F.col("target")).alias("same"))


def verify(source: DataFrame, target: DataFrame, key: str | None = None) -> Comparison:
    """Compare two tables as bags of rows.

    Each side is scanned once; order-free 128-bit sums of row hashes are compared by part, at most MOST_PARTS intervals of the key
    (256 parts by hash for a table without a usable one). Rows of parts whose sums differ, and only these, are counted by
    value on either side, which shuffles them. The target's values are taken as the source's types, as a database has types
    of its own. Null keys form a part of their own; empty tables are equal. Columns go by their names, whatever their order;
    others than the source's are an error.
    """
    columns = source.columns
    if {c.lower() for c in columns} != {c.lower() for c in target.columns}:
        raise ValueError(f"columns differ: {', '.join(sorted({c.lower() for c in columns} ^ {c.lower() for c in target.columns}))}")
    # By position, so that no name of theirs clashes with one used here.
    target = target.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f"c{i}") for i, f in enumerate(source.schema)])
    source = source.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = _Parts(source, target, None if key is None else f"c{columns.index(key)}")
    found = part_sums(source, target, parts).collect()  # at most MOST_PARTS + 1 rows
    other = sorted(r["part"] for r in found if not r["same"])
    missing = extra = 0
    if other:
        sides = [parts.within(df if parts.key else _hashed(df), other).select(*source.columns) for df in (source, target)]
        _, _, missing, extra = reconcile(*sides).first()
    spans = tuple((*parts.bounds(n),) for n in other)
    return Comparison(len(found), len(other), sum(r["source_rows"] for r in found), sum(r["target_rows"] for r in found), missing, extra, spans)
