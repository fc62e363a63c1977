"""Guards against division by zero, and names as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name, whatever characters it has, for F.col and SQL text."""
    return f"`{name.replace('`', '``')}`"


def whole(x: int) -> Column:
    """A whole number of any size as a literal."""
    return F.lit(x) if -(2**63) <= x < 2**63 else F.lit(Decimal(x))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def rate(rows: Column, seconds: Column) -> Column:
    """Rows a second; 0 where no time has passed."""
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))
