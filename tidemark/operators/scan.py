"""What a table's rows say about its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from ..functions import quoted
from ..model import KeyRange


def usable_key(kind: DataType) -> bool:
    """Can chunks be intervals of this type? Whole numbers only: others would lose what lies between chunks."""
    return isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale == 0)


def key_range(rows: DataFrame, key: str) -> KeyRange:
    """Least and greatest key, and numbers of rows: one aggregate, of which Parquet reads one column."""
    k = F.col(quoted(key))
    return range_of(rows.agg(F.min(k), F.max(k), F.count(F.lit(1)), F.count(k)))


def range_of(stats: DataFrame) -> KeyRange:
    """From one row: least key, greatest key, rows, rows with a key."""
    low, high, n, keyed = stats.first()
    return KeyRange(int(low or 0), int(high or 0), int(n), int(n) - int(keyed))


def key_range_frame(rows: DataFrame, key: str) -> DataFrame:
    """min_pk and max_pk as one row, 0 and 0 for an empty table."""
    k = F.col(quoted(key)).cast("long")
    return rows.agg(F.coalesce(F.min(k), F.lit(0)).alias("min_pk"), F.coalesce(F.max(k), F.lit(0)).alias("max_pk"))


def row_count(rows: DataFrame) -> int:
    """Exact, and cheap: Parquet keeps counts, no column is read."""
    return rows.count()
