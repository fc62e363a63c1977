"""A database of the Spark catalog. As a target, tables are Parquet, with a partition for each wave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import quoted
from ..model import Chunk, SourceFile
from .base import WAVE, Catalog, ForeignData
from .ddl import TableDef

OWN, KEY = "tidemark.written", "tidemark.primary_key"


class WarehouseCatalog(Catalog):
    """Keys are in the table property tidemark.primary_key."""

    def __init__(self, spark: SparkSession, database: str, keys: dict[str, str | None] | None = None):
        super().__init__(spark, keys)
        self.database = database

    @property
    def identity(self) -> str:
        return f"warehouse:{self.database}"

    def name(self, table: str) -> str:
        return f"{quoted(self.database)}.{quoted(table)}"

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and t.tableType != "VIEW")

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def load(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table)).drop(WAVE)

    def files(self, table: str) -> list[SourceFile] | None:
        return self._spark_files(table)

    def _properties(self, table: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()}

    def known_key(self, table: str) -> str | None:
        return self._properties(table).get(KEY)

    def create(self, table: str, schema: StructType, key: str | None, key_columns: list[str] | None = None, like: TableDef | None = None) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(self.database)}")
        empty = self.spark.createDataFrame([], StructType([*schema.fields]).add(WAVE, LongType()))
        empty.write.format("parquet").partitionBy(WAVE).saveAsTable(self.name(table))
        more = f", '{KEY}' = '{key}'" if key else ""
        self.spark.sql(f"ALTER TABLE {self.name(table)} SET TBLPROPERTIES ('{OWN}' = 'true'{more})")

    def _need_own(self, table: str) -> None:
        if self.exists(table) and OWN not in self._properties(table):
            raise ForeignData(f"{self.name(table)} was not written by this engine; it isn't emptied")

    def _waves(self, table: str) -> list[int]:
        return [int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()]

    def truncate(self, table: str) -> None:
        self._need_own(table)
        self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")

    def drop_after(self, table: str, key: str, last: int | None) -> None:
        self._need_own(table)
        for wave in self._waves(table):
            if last is None or wave > last:
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP PARTITION ({WAVE} = {wave})")

    def write_wave(self, table: str, rows: DataFrame, wave: Chunk, key: str, batch: int) -> None:
        self._put(table, rows, wave.start)

    def _put(self, table: str, rows: DataFrame, wave: int) -> None:
        """Replace one partition: what a failed attempt left of it goes, other waves aren't touched."""
        self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({WAVE} = {wave})")
        rows.withColumn(WAVE, F.lit(wave).cast("long")).write.mode("append").insertInto(self.name(table))

    def replace(self, table: str, rows: DataFrame, batch: int) -> None:
        self._need_own(table)
        stage = f"stage_{table}_{uuid.uuid4().hex}"
        try:
            self.create(stage, rows.schema, None)
            self._put(stage, rows, 0)
        except BaseException:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(stage)}")
            raise
        old, there = f"old_{stage}", self.exists(table)
        if there:
            self.spark.sql(f"ALTER TABLE {self.name(table)} RENAME TO {self.name(old)}")
        try:
            self.spark.sql(f"ALTER TABLE {self.name(stage)} RENAME TO {self.name(table)}")
        except BaseException:  # both are still there: the new one keeps its stage's name, the old one gets its own back
            if there:
                self.spark.sql(f"ALTER TABLE {self.name(old)} RENAME TO {self.name(table)}")
            raise
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(old)}")

    def append(self, table: str, rows: DataFrame) -> None:
        if not self.exists(table):
            self.create(table, rows.schema, None)
        rows.withColumn(WAVE, F.lit(0).cast("long")).write.mode("append").insertInto(self.name(table))

    def compact(self, table: str, schema: StructType, rows: list[dict]) -> None:
        old = self._waves(table)
        frame = self.spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema).coalesce(1)
        self._put(table, frame, max(old, default=0) + 1)
        for wave in old:
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP PARTITION ({WAVE} = {wave})")
