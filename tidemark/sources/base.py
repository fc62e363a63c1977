"""What a database of tables can do, for reading and as a target."""

from __future__ import annotations

import abc
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Endpoint, SyncOptions
from ..functions import quoted, whole
from ..model import Chunk, SourceFile, Wave
from ..plans import waves
from .ddl import TableDef

#: Fixed value: the ledger's name in a target. Beside it, how much of each table's files is copied, and what was tried again.
PROGRESS, SPLITS, RETRIES = "sync_progress", "sync_splits", "sync_retries"
#: Marks the rows of a wave in targets that Spark stores; readers don't see it.
WAVE = "_wave_start"
logger = logging.getLogger(__name__)


class Catalog(abc.ABC):
    """Tables by name. Key lookup: keys given by configuration, then what the database knows, then none."""

    #: Does the database find a key range without scanning the table? Do range scans come in the key's order?
    indexed = ordered = False
    #: Rows that a database hands out at a time.
    fetch_rows = 5_000

    def __init__(self, spark: SparkSession, keys: dict[str, str | None] | None = None):
        self.spark = spark
        self.keys = dict(keys or {})

    @property
    @abc.abstractmethod
    def identity(self) -> str:
        """Equal for two catalogs of the same tables."""

    @abc.abstractmethod
    def tables(self) -> list[str]:
        """Base tables, in the order of their names."""

    @abc.abstractmethod
    def exists(self, table: str) -> bool: ...

    @abc.abstractmethod
    def load(self, table: str) -> DataFrame: ...

    @abc.abstractmethod
    def known_key(self, table: str) -> str | None:
        """The leading column of the primary key, as the database has it."""

    def discover(self) -> list[str]:
        """The tables that can be copied: all but the ledger's name."""
        found = self.tables()
        if PROGRESS in found:
            logger.warning("a source table is named %s, as the ledger is; it isn't copied", PROGRESS)
        return [t for t in found if t not in (PROGRESS, SPLITS, RETRIES)]

    def columns(self, table: str) -> list[str]:
        return self.load(table).columns

    def key(self, table: str) -> str | None:
        return self.keys[table] if table in self.keys else self.known_key(table)

    def key_columns(self, table: str) -> list[str]:
        """All columns of the primary key that the database itself keeps."""
        return []

    def definition(self, table: str) -> TableDef | None:
        """The whole definition, of databases that have more than columns."""
        return None

    def ddl(self, table: str) -> str:
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in self.load(table).schema)
        key = self.key(table)
        return f"CREATE TABLE {quoted(table)} ({columns})" + (f" /* key {key} */" if key else "")

    def full_scan(self, table: str) -> DataFrame:
        """All rows, every column by name."""
        df = self.load(table)
        return df.select(*[F.col(quoted(c)) for c in df.columns])

    def range_scan(self, table: str, key: str, span: Chunk, chunk_size: int) -> DataFrame:
        """Rows whose key is in an inclusive interval; the predicate reaches the scan."""
        return self.full_scan(table).where(F.col(quoted(key)).between(whole(span.start), whole(span.end)))

    def key_waves(self, table: str, key: str, span: Chunk, chunk_size: int, count: int | None) -> list[Wave]:
        """Waves that cover the span's keys. Here each is a scan, so there is one unless more are asked for."""
        return [Wave(c.start, c.end) for c in waves(span.start, span.end, chunk_size, count or 1)]

    def all_rows(self, table: str, key: str | None, chunk_size: int) -> DataFrame:
        """The whole table in no order, for a database by intervals of a key of whole numbers, if it has one; filters may be pushed into it."""
        return self.full_scan(table)

    def bulk_scan(self, table: str, rows: int, chunk_size: int) -> DataFrame:
        """All rows of a table without a key that has so many."""
        return self.full_scan(table)

    def files(self, table: str) -> list[SourceFile] | None:
        """The files that hold the table's rows, by path; None if its rows aren't in files. Footers are read for it, no columns."""
        return None

    def file_scan(self, table: str, first: str, last: str) -> DataFrame:
        """Rows of the files from one path to another; the scan opens no others."""
        df = self.load(table)
        return df.where(df.metadataColumn("_metadata")["file_path"].between(first, last)).select(*[F.col(quoted(c)) for c in df.columns])

    def _spark_files(self, table: str) -> list[SourceFile] | None:
        """By Spark's own metadata columns; a row for each file comes to the driver, which has listed them as well."""
        df = self.load(table)
        try:
            meta = df.metadataColumn("_metadata")
            found = df.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        except AnalysisException:
            return None
        return sorted((SourceFile(r["path"], r["bytes"], r["rows"]) for r in found.collect()), key=lambda f: f.path)

    def key_stats(self, table: str, key: str) -> DataFrame:
        """One row: least key, greatest key, rows, rows with a key."""
        k = F.col(quoted(key))
        return self.load(table).agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count(F.lit(1)).alias("n"), F.count(k).alias("keyed"))

    def count(self, table: str) -> int:
        """Exact; Parquet keeps counts, so no column is read."""
        return self.load(table).count()

    # As a target.

    @abc.abstractmethod
    def create(self, table: str, schema: StructType, key: str | None, key_columns: list[str] | None = None, like: TableDef | None = None) -> None:
        """An empty table; it must not exist. key_columns: the source's whole primary key, for stores that have one. like: its whole definition, for stores of its kind."""

    @abc.abstractmethod
    def truncate(self, table: str) -> None:
        """Remove the rows, keep the table. Raises ForeignData for a table of other origin."""

    @abc.abstractmethod
    def drop_after(self, table: str, key: str, last: int | None) -> None:
        """Remove what was written for keys above `last` (None: all)."""

    @abc.abstractmethod
    def write_wave(self, table: str, rows: DataFrame, wave: Chunk, key: str, batch: int) -> None:
        """Store a wave's rows. Called again for a wave, it leaves them there once."""

    @abc.abstractmethod
    def replace(self, table: str, rows: DataFrame, batch: int) -> None:
        """Make `rows` the whole table, in one step as far as the store can."""

    def recover(self, table: str) -> None:
        """Undo or finish what a replacement that died left of the table."""

    def finish(self, table: str) -> None:
        """Called when a table's rows are all there."""

    @abc.abstractmethod
    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table, which is created if absent. For the ledger."""

    def append_row(self, table: str, schema: StructType, values: dict) -> None:
        """Add one row to a table, which exists."""
        self.append(table, self.spark.createDataFrame([tuple(values[f.name] for f in schema)], schema).coalesce(1))

    def compact(self, table: str, schema: StructType, rows: list[dict]) -> None:
        """Make a few rows of an appended table, its latest ones, all that it holds. They are there
        before the others go, so a run that dies midway leaves some twice. Stores without files need none of this."""


class ForeignData(RuntimeError):
    """A target holds data that this engine didn't write."""


def open_catalog(spark: SparkSession, endpoint: Endpoint, options: SyncOptions) -> Catalog:
    from .jdbc import JdbcCatalog
    from .parquet import ParquetCatalog
    from .warehouse import WarehouseCatalog

    s = endpoint.settings
    if endpoint.kind == "parquet":
        return ParquetCatalog(spark, s["path"], options.keys)
    if endpoint.kind == "warehouse":
        return WarehouseCatalog(spark, s["database"], options.keys)
    return JdbcCatalog.of(spark, s, options.keys)
