"""Records that the operators exchange."""

from __future__ import annotations

import enum
from dataclasses import dataclass
from datetime import datetime


class Mode(enum.Enum):
    """FULL empties the targets and copies all; RESUME keeps what is committed; RESTART also forgets the ledger first."""

    FULL = "full"
    RESUME = "resume"
    RESTART = "restart"


@dataclass(frozen=True)
class KeyRange:
    """Least and greatest key, (0, 0) for an empty table; rows, and how many of them have no key."""

    low: int
    high: int
    rows: int = 0
    nulls: int = 0


@dataclass(frozen=True)
class Chunk:
    """An inclusive interval of key values."""

    start: int
    end: int


@dataclass(frozen=True)
class Wave(Chunk):
    """A chunk, or run of chunks, that one Spark job copies; parts: the intervals that its tasks read, if the source has chosen them."""

    parts: tuple[Chunk, ...] = ()


@dataclass(frozen=True)
class SourceFile:
    """A file of a table that Spark reads, by the path that it gives it."""

    path: str
    bytes: int
    rows: int


@dataclass(frozen=True)
class Files:
    """How much of a table's files, in the order of their paths, is in the target: up to last, with the greatest key."""

    files: int = 0
    bytes: int = 0
    rows: int = 0
    last: str | None = None
    high: int | None = None


@dataclass(frozen=True)
class Progress:
    """A table's line in the ledger. last_pk_value None: nothing is committed."""

    table_name: str
    total_rows: int
    synced_rows: int
    primary_key: str
    last_pk_value: int | None
    status: str
    started_at: datetime | None
    finished_at: datetime | None
    updated_at: datetime
    error: str | None


@dataclass
class SyncResult:
    """rows counts what the target holds of the table, copied (of it) what this run wrote, retries its further attempts."""

    table: str
    rows: int = 0
    time: float = 0.0
    error: str | None = None
    skipped: bool = False
    copied: int = 0
    retries: int = 0


@dataclass(frozen=True)
class Comparison:
    """Two tables as bags of rows: parts compared, how many differ and their first and last keys (None: rows without a key); rows of either table, and those that only one has."""

    parts: int
    differing: int
    source_rows: int
    target_rows: int
    missing_rows: int
    extra_rows: int
    spans: tuple[tuple[int | None, int | None], ...] = ()

    @property
    def same(self) -> bool:
        return not (self.missing_rows or self.extra_rows)
