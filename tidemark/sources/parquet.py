"""A folder of Parquet tables.

A table is a file or folder <name>.parquet. As a target, a table is a folder with one folder
for each wave: a wave that is written again replaces its own folder and no other.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..model import Chunk, SourceFile
from .base import WAVE, Catalog, ForeignData
from .ddl import TableDef
from .files import Files

#: Says that this engine wrote a folder; holds the table's schema. Beside it, the columns of its primary key.
MARKER, KEY_MARKER = "_tidemark_schema", "_tidemark_key"
SUFFIX = ".parquet"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0), "timestamp": pa.timestamp("us", "UTC")}


class ParquetCatalog(Catalog):
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str | None] | None = None):
        super().__init__(spark, keys)
        self.root = root.rstrip("/")
        self.hdfs = Files(spark)

    @property
    def identity(self) -> str:
        return self.hdfs.full(self.root)

    def place(self, table: str) -> str:
        if not table or "/" in table:
            raise ValueError(f"not a table's name: {table!r}")
        return f"{self.root}/{table}{SUFFIX}"

    def tables(self) -> list[str]:
        return [n.removesuffix(SUFFIX) for n in self.hdfs.names(self.root) if n.endswith(SUFFIX) and n[0] not in "._"]

    def exists(self, table: str) -> bool:
        return self.hdfs.exists(self.place(table))

    def _own(self, table: str) -> StructType | None:
        """The schema of a table that this engine wrote."""
        path = f"{self.place(table)}/{MARKER}"
        if not self.hdfs.exists(path):
            return None
        return StructType.fromJson(json.loads(self.hdfs.read(path)))

    def load(self, table: str) -> DataFrame:
        schema = self._own(table)
        if schema is None:
            return self.spark.read.parquet(self.place(table))
        waves = self._waves(table)
        if not waves:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.place(table)}/{w}" for w in waves])

    def files(self, table: str) -> list[SourceFile] | None:
        return self._spark_files(table)

    def known_key(self, table: str) -> str | None:
        found = self.key_columns(table)
        return found[0] if found else None

    def key_columns(self, table: str) -> list[str]:
        """The key that a table was created with; files that others wrote have none."""
        path = f"{self.place(table)}/{KEY_MARKER}"
        return json.loads(self.hdfs.read(path)) if self.hdfs.exists(path) else []

    def _waves(self, table: str) -> list[str]:
        return [n for n in self.hdfs.names(self.place(table)) if n.startswith(f"{WAVE}=")]

    def create(self, table: str, schema: StructType, key: str | None, key_columns: list[str] | None = None, like: TableDef | None = None) -> None:
        self.hdfs.make(self.place(table))
        if own := key_columns or ([key] if key else []):
            self.hdfs.write(f"{self.place(table)}/{KEY_MARKER}", json.dumps(own).encode())
        self.hdfs.write(f"{self.place(table)}/{MARKER}", schema.json().encode())

    def _need_own(self, table: str) -> None:
        if self.exists(table) and self._own(table) is None:
            raise ForeignData(f"{self.place(table)} was not written by this engine; it isn't emptied")

    def truncate(self, table: str) -> None:
        self._need_own(table)
        for w in self._waves(table):
            self.hdfs.remove(f"{self.place(table)}/{w}")

    def drop_after(self, table: str, key: str, last: int | None) -> None:
        self._need_own(table)
        for w in self._waves(table):
            if last is None or int(w.partition("=")[2]) > last:
                self.hdfs.remove(f"{self.place(table)}/{w}")

    def write_wave(self, table: str, rows: DataFrame, wave: Chunk, key: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place(table)}/{WAVE}={wave.start}")

    def replace(self, table: str, rows: DataFrame, batch: int) -> None:
        self._need_own(table)
        stage, old = (f"_{what}_{table}_{uuid.uuid4().hex}" for what in ("stage", "old"))
        try:
            self.create(stage, rows.schema, None, self.key_columns(table))
            rows.write.parquet(f"{self.place(stage)}/{WAVE}=0")
        except BaseException:
            self.hdfs.remove(self.place(stage))
            raise
        there = self.exists(table)
        if there:
            self.hdfs.move(self.place(table), self.place(old))
        try:
            self.hdfs.move(self.place(stage), self.place(table))
        except BaseException:  # both are still there: the new one keeps its stage's name, the old one gets its own back
            if there:
                self.hdfs.move(self.place(old), self.place(table))
            raise
        if there:
            self.hdfs.remove(self.place(old))

    def append_row(self, table: str, schema: StructType, values: dict) -> None:
        """A file of one row, made without a Spark job."""
        self._write_rows(table, schema, [values], 0)

    def _write_rows(self, table: str, schema: StructType, rows: list[dict], wave: int) -> None:
        own = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pylist([{f.name: r[f.name] for f in schema} for r in rows], own), sink)
        self.hdfs.write(f"{self.place(table)}/{WAVE}={wave}/row-{uuid.uuid4().hex}.parquet", sink.getvalue().to_pybytes())

    def compact(self, table: str, schema: StructType, rows: list[dict]) -> None:
        old = self._waves(table)
        self._write_rows(table, schema, rows, max((int(w.partition("=")[2]) for w in old), default=0) + 1)
        for w in old:
            self.hdfs.remove(f"{self.place(table)}/{w}")

    def append(self, table: str, rows: DataFrame) -> None:
        if not self.exists(table):
            self.create(table, rows.schema, None)
        rows.write.mode("append").parquet(f"{self.place(table)}/{WAVE}=0")
