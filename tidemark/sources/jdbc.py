"""A database behind JDBC. MySQL needs its driver's jar on Spark's class path."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from ..model import Chunk, Wave
from ..plans import balanced, grouped, waves
from . import ddl
from .base import Catalog

TIMEOUT_S = 3600
#: Partitions of a wave, each a query by the key's index; waves at least, where ranges are enough; ranges of a table.
WAVE_PARTS, WAVES, MOST_RANGES = 256, 4, 10_000
#: Names of a replaced table's new and old rows, while they change places.
NEW, OLD = "__new", "__old"


class JdbcCatalog(Catalog):
    """parts: connections that read a table without a key, each the rows of one bucket."""

    indexed = True

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, schema: str | None = None, keys: dict[str, str | None] | None = None, parts: int = 4):
        super().__init__(spark, keys)
        self.url, self.schema, self.parts = url, schema, parts
        self.properties = {k: str(v) for k, v in (properties or {}).items()}
        self.mysql, self.derby = url.startswith("jdbc:mysql"), url.startswith("jdbc:derby")
        self.mark = "`" if self.mysql else '"'

    @classmethod
    def of(cls, spark: SparkSession, s: dict, keys: dict[str, str | None]) -> JdbcCatalog:
        """From settings: url, or a MySQL server's host, port, database and charset.

        MySQL's driver is told to read by cursor (else it holds a whole result), to send batches as such, and
        to fail on dates of zeros, which no other store has, rather than to change them.
        """
        url, schema = s.get("url"), s.get("schema")
        if not url:
            charset = {"utf8mb4": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1"}.get(s.get("charset", "utf8mb4"), s.get("charset"))
            url = (
                f"jdbc:mysql://{s['host']}:{s['port']}/{quote(s['database'])}?characterEncoding={charset}&zeroDateTimeBehavior=EXCEPTION&tinyInt1isBit=false"
                f"&useCursorFetch=true&rewriteBatchedStatements=true&connectTimeout={TIMEOUT_S * 1000}&socketTimeout={TIMEOUT_S * 1000}"
            )
        return cls(spark, url, {k: s[k] for k in ("user", "password", "driver") if s.get(k)}, schema, keys, int(s.get("parts", 4)))

    @property
    def identity(self) -> str:
        return f"{self.url.partition('?')[0]}#{self.schema or ''}"

    def quoted(self, name: str) -> str:
        return self.mark + name.replace(self.mark, self.mark * 2) + self.mark

    def name(self, table: str) -> str:
        return (f"{self.quoted(self.schema)}." if self.schema else "") + self.quoted(table)

    def _connect(self):
        jvm = self.spark._jvm
        if driver := self.properties.get("driver"):
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        own = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k in ("user", "password"):
                own.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, own)

    def _place(self, connection) -> tuple[str | None, str | None]:
        """Catalog and schema in the terms of JDBC metadata."""
        return (connection.getCatalog(), None) if self.mysql else (None, self.schema or connection.getSchema())

    def _metadata(self, ask):
        connection = self._connect()
        try:
            return ask(connection.getMetaData(), *self._place(connection))
        finally:
            connection.close()

    def execute(self, *statements: str) -> None:
        """In one transaction, where the database has them."""
        connection = self._connect()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                for s in statements:
                    statement.executeUpdate(s)
                connection.commit()
            except Exception:
                connection.rollback()
                raise
        finally:
            connection.close()

    def tables(self) -> list[str]:
        def ask(meta, catalog, schema):
            kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 2)
            kinds[0], kinds[1] = "TABLE", "BASE TABLE"
            found, rows = [], meta.getTables(catalog, schema, None, kinds)
            while rows.next():
                found.append(rows.getString("TABLE_NAME"))
            return found

        return sorted(self._metadata(ask))

    @staticmethod
    def _pattern(meta, table: str) -> str:
        """A pattern that a table's name alone matches."""
        escape = meta.getSearchStringEscape()
        return "".join(escape + c if c in ("%", "_", escape) else c for c in table)

    def exists(self, table: str) -> bool:
        def ask(meta, catalog, schema):
            rows, found = meta.getTables(catalog, schema, self._pattern(meta, table), None), False
            while not found and rows.next():
                found = rows.getString("TABLE_NAME") == table
            return found

        return self._metadata(ask)

    def known_key(self, table: str) -> str | None:
        found = self.key_columns(table)
        return found[0] if found else None

    def key_columns(self, table: str) -> list[str]:
        def ask(meta, catalog, schema):
            found, rows = [], meta.getPrimaryKeys(catalog, schema, table)
            while rows.next():
                found.append((rows.getShort("KEY_SEQ"), rows.getString("COLUMN_NAME")))
            return sorted(found)

        return [name for _, name in self._metadata(ask)]

    def definition(self, table: str) -> ddl.TableDef:
        """The table as its database defines it."""
        found = self._metadata(lambda meta, catalog, schema: ddl.read(meta, catalog, schema, table, self._pattern(meta, table)))
        if self.derby and any(c.identity for c in found.columns):
            return replace(found, columns=tuple(replace(c, identity=self._numbering(table)[c.name]) if c.identity else c for c in found.columns))
        if not self.mysql:
            return found
        connection = self._connect()
        try:
            rows = connection.createStatement().executeQuery(f"SHOW CREATE TABLE {self.name(table)}")
            rows.next()
            return ddl.TableDef(found.product, found.columns, found.key, found.indexes, rows.getString(2))
        finally:
            connection.close()

    def _numbering(self, table: str) -> dict[str, tuple[int, int]]:
        """Start and step of Derby's columns that number themselves, which its JDBC metadata leave out."""
        text = table.replace("'", "''")
        where = f"T.TABLENAME = '{text}' AND C.AUTOINCREMENTINC IS NOT NULL" + (f" AND S.SCHEMANAME = '{self.schema}'" if self.schema else "")
        tables = "SYS.SYSCOLUMNS C JOIN SYS.SYSTABLES T ON C.REFERENCEID = T.TABLEID JOIN SYS.SYSSCHEMAS S ON T.SCHEMAID = S.SCHEMAID"
        rows = self._asked(f"SELECT C.COLUMNNAME AS C, C.AUTOINCREMENTSTART AS A, C.AUTOINCREMENTINC AS B FROM {tables} WHERE {where}").collect()
        return {r["C"]: (int(r["A"]), int(r["B"])) for r in rows}

    def ddl(self, table: str) -> str:
        found = self.definition(table)
        return found.text or "; ".join(ddl.statements(found, self.name(table), self.quoted, str))

    # Reading.

    def _options(self) -> dict[str, str]:
        return self.properties | {"preferTimestampNTZ": "true", "fetchsize": str(self.fetch_rows), "queryTimeout": str(TIMEOUT_S)}

    def load(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, self.name(table), properties=self._options())

    def _asked(self, query: str) -> DataFrame:
        """A query that the database itself answers."""
        return self.spark.read.jdbc(self.url, f"({query}) q", properties=self._options())

    def _by(self, table: str, predicates: list[str]) -> DataFrame:
        return self.spark.read.jdbc(self.url, self.name(table), predicates=predicates, properties=self._options())

    def key_stats(self, table: str, key: str) -> DataFrame:
        k = self.quoted(key)
        names = [self.quoted(x) for x in ("low", "high", "n", "keyed")]
        asked = ", ".join(f"{what} AS {name}" for what, name in zip((f"MIN({k})", f"MAX({k})", "COUNT(*)", f"COUNT({k})"), names, strict=True))
        return self._asked(f"SELECT {asked} FROM {self.name(table)}").select("low", "high", "n", "keyed")

    def count(self, table: str) -> int:
        return int(self._asked(f"SELECT COUNT(*) AS {self.quoted('n')} FROM {self.name(table)}").first()[0])

    def histogram(self, table: str, key: str, span: Chunk, width: int) -> dict[int, int]:
        """Numbers of rows by interval of `width` keys from the span's start on, empty ones left out; the database counts them along the key's index."""
        k, at, n = self.quoted(key), self.quoted("at"), self.quoted("n")
        number = f"({k} - {span.start}) DIV {width}" if self.mysql else f"CAST((CAST({k} AS BIGINT) - {span.start}) / {width} AS BIGINT)"
        inner = f"SELECT {number} AS {at} FROM {self.name(table)} WHERE {k} >= {span.start} AND {k} <= {span.end}"
        rows = self._asked(f"SELECT {at}, COUNT(*) AS {n} FROM ({inner}) b GROUP BY {at}").collect()  # one for each interval, whose number is bounded
        return {int(r["at"]): int(r["n"]) for r in rows}

    def ranges(self, table: str, key: str, span: Chunk, rows_each: int) -> list[Chunk]:
        """Intervals of the span with about as many rows each, whatever gaps and outliers the keys have.

        Keys beyond 64 bits are cut into equal intervals.
        """
        if not isinstance(self.load(table).schema[key].dataType, IntegralType):
            return waves(span.start, span.end, rows_each, MOST_RANGES)
        return balanced(span, rows_each, MOST_RANGES, lambda part, width: self.histogram(table, key, part, width))

    def key_waves(self, table: str, key: str, span: Chunk, chunk_size: int, count: int | None) -> list[Wave]:
        parts = self.ranges(table, key, span, chunk_size)
        return grouped(parts, count or max(WAVES, -(-len(parts) // WAVE_PARTS)))

    def range_scan(self, table: str, key: str, span: Chunk, chunk_size: int) -> DataFrame:
        """One partition, hence one query by the key's index, for each range of the wave; each gives its rows in the key's order."""
        k = self.quoted(key)
        parts = span.parts if isinstance(span, Wave) and span.parts else self.ranges(table, key, span, chunk_size)
        return self._by(table, [f"{k} >= {c.start} AND {k} <= {c.end} ORDER BY {k}" for c in parts])

    ordered = True

    def all_rows(self, table: str, key: str | None, chunk_size: int) -> DataFrame:
        """By ranges of the key, as a copy has them, and the rows without a key; else by buckets."""
        if key is None:
            return self.bulk_scan(table, self.count(table), chunk_size)
        found, k = self.key_stats(table, key).first(), self.quoted(key)
        parts = self.ranges(table, key, Chunk(int(found["low"]), int(found["high"])), chunk_size) if found["keyed"] else []
        return self._by(table, [*[f"{k} >= {c.start} AND {k} <= {c.end}" for c in parts], f"{k} IS NULL"])

    def bulk_scan(self, table: str, rows: int, chunk_size: int) -> DataFrame:
        """A table without a key through several connections: each reads the rows of one bucket, by a hash that the database works out."""
        n = min(self.parts, -(-rows // chunk_size))
        bucket = self.bucket(self.load(table).schema, n)
        return self._by(table, [f"{bucket} = {i}" for i in range(n)]) if n > 1 and bucket else self.full_scan(table)

    def bucket(self, schema: StructType, n: int) -> str | None:
        """A row's bucket, 0 to n - 1, as SQL over its columns; None if none can be hashed. Nulls count as zero or nothing, so each row has one."""
        names = [(self.quoted(f.name), f.dataType) for f in schema]
        if self.mysql:
            return f"MOD(CRC32(CONCAT_WS('#', {', '.join(c for c, _ in names)})), {n})"
        terms = [f"MOD(COALESCE({c}, 0), {n})" if isinstance(kind, IntegralType) else f"LENGTH(COALESCE({c}, ''))" for c, kind in names if isinstance(kind, IntegralType | StringType)]
        return f"MOD(MOD({' + '.join(terms)}, {n}) + {n}, {n})" if terms else None

    # As a target.

    def create(self, table: str, schema: StructType, key: str | None, key_columns: list[str] | None = None, like: ddl.TableDef | None = None) -> None:
        """Like the source's table, if that is one of the same product; else columns by Spark's type mapping, and the source's primary key."""
        if like is not None and like.product == self._metadata(lambda meta, *_: meta.getDatabaseProductName()):
            self.execute(*([like.text] if like.text else ddl.statements(like, self.name(table), self.quoted, str)))
            return
        own = key_columns or []
        fields = StructType([StructField(f.name, f.dataType, f.nullable and f.name not in own) for f in schema])
        self.spark.createDataFrame([], fields).write.jdbc(self.url, self.name(table), mode="ignore", properties=self.properties)
        if own:
            self.execute(f"ALTER TABLE {self.name(table)} ADD PRIMARY KEY ({', '.join(map(self.quoted, own))})")

    def truncate(self, table: str) -> None:
        self.execute(f"TRUNCATE TABLE {self.name(table)}")

    def drop_after(self, table: str, key: str, last: int | None) -> None:
        self.execute(f"DELETE FROM {self.name(table)}" + ("" if last is None else f" WHERE {self.quoted(key)} > {last}"))

    def _append(self, table: str, rows: DataFrame, batch: int) -> None:
        narrow = {c.name: c.type for c in self.definition(table).columns if re.match(r"(VAR)?CHAR\(\d+\)$", c.type)} if self.derby else {}
        if not narrow:
            self._insert(table, rows, batch)
            return
        # Spark sends Derby's nulls of texts as CLOBs, which its shorter texts don't take; they go by way of a table of Spark's own types.
        stage = f"stage_{uuid.uuid4().hex[:16]}"
        self.spark.createDataFrame([], rows.schema).write.jdbc(self.url, self.name(stage), properties=self.properties)
        try:
            self._insert(stage, rows, batch)
            values = ", ".join(f"CAST({self.quoted(c)} AS {narrow[c]})" if c in narrow else self.quoted(c) for c in rows.columns)
            self.execute(f"INSERT INTO {self.name(table)} ({', '.join(map(self.quoted, rows.columns))}) SELECT {values} FROM {self.name(stage)}")
        finally:
            self.execute(f"DROP TABLE {self.name(stage)}")

    def _insert(self, table: str, rows: DataFrame, batch: int) -> None:
        rows.write.option("batchsize", batch).jdbc(self.url, self.name(table), mode="append", properties=self.properties)

    def write_wave(self, table: str, rows: DataFrame, wave: Chunk, key: str, batch: int) -> None:
        """Rows of the wave's keys that a failed attempt left are removed first, so a wave written again is there once."""
        k = self.quoted(key)
        self.execute(f"DELETE FROM {self.name(table)} WHERE {k} >= {wave.start} AND {k} <= {wave.end}")
        self._append(table, rows, batch)

    def finish(self, table: str) -> None:
        """Columns that number themselves go on behind the copied values. MySQL does so by itself."""
        if self.mysql:
            return
        for c in self.definition(table).columns:
            if c.identity:
                most = "MAX" if c.identity[1] > 0 else "MIN"
                last = self._asked(f"SELECT {most}({self.quoted(c.name)}) AS {self.quoted('last')} FROM {self.name(table)}").first()[0]
                if last is not None:
                    self.execute(f"ALTER TABLE {self.name(table)} ALTER COLUMN {self.quoted(c.name)} RESTART WITH {int(last) + c.identity[1]}")

    def replace(self, table: str, rows: DataFrame, batch: int) -> None:
        """The rows are loaded into a table like this one, which then takes its name. Whatever fails, the old or the new rows are there whole, and no transaction holds them."""
        self.recover(table)
        new, old = table + NEW, table + OLD
        if self.mysql:
            self.execute(f"CREATE TABLE {self.name(new)} LIKE {self.name(table)}")
        else:
            self.execute(*ddl.statements(self.definition(table), self.name(new), self.quoted, lambda name: f"ix_{uuid.uuid4().hex[:16]}"))
        try:
            self._append(new, rows, batch)
            self._swap(table, new, old)
        except BaseException:
            self.recover(table)
            raise
        self.execute(f"DROP TABLE {self.name(old)}")

    def _swap(self, table: str, new: str, old: str) -> None:
        if self.mysql:  # in one step
            self.execute(f"RENAME TABLE {self.name(table)} TO {self.name(old)}, {self.name(new)} TO {self.name(table)}")
        else:
            self._rename(table, old)
            self._rename(new, table)

    def _rename(self, table: str, name: str) -> None:
        self.execute(f"RENAME TABLE {self.name(table)} TO {self.quoted(name)}" if self.derby else f"ALTER TABLE {self.name(table)} RENAME TO {self.quoted(name)}")

    def recover(self, table: str) -> None:
        """Undo or finish a replacement that died: the table gets its name back, and what was beside it goes."""
        if not self.exists(table) and self.exists(table + OLD):
            self._rename(table + OLD, table)
        if self.exists(table):
            for other in (table + NEW, table + OLD):
                if self.exists(other):
                    self.execute(f"DROP TABLE {self.name(other)}")

    def append(self, table: str, rows: DataFrame) -> None:
        if not self.exists(table):
            self.create(table, rows.schema, None)
        self._append(table, rows, 1000)
