"""Copies that go on where a run died, table definitions, ranges of keys, and what is told of running copies."""

import logging
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.config import SyncOptions
from tidemark.model import Chunk, Files, Mode, SourceFile, Wave
from tidemark.operators import SyncEngine, reconcile
from tidemark.operators.ledger import Splits
from tidemark.operators.unique import repeated_keys
from tidemark.plans import balanced, file_waves, grouped
from tidemark.sources import JdbcCatalog, ParquetCatalog, WarehouseCatalog, ddl

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def derby(spark, **more):
    return JdbcCatalog(spark, f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", DERBY, **more)


def same(source, target, table):
    return tuple(reconcile(source.load(table), target.load(table)).first())[2:] == (0, 0)


# Waves of files.


class Watched(ParquetCatalog):
    """Keeps which files were scanned."""

    def __init__(self, *args):
        super().__init__(*args)
        self.read = []

    def file_scan(self, table, first, last):
        self.read += [f for f in self.files(table) if first <= f.path <= last]
        return super().file_scan(table, first, last)


@pytest.fixture
def orders(spark, tmp_path):
    """A table in twelve files, whose keys are in no order."""
    rows = spark.range(-500, 5500).select(F.col("id"), F.repeat(F.col("id").cast("string"), 20).alias("x")).repartition(12)
    rows.write.parquet(str(tmp_path / "source" / "orders.parquet"))
    return str(tmp_path)


def run(spark, path, mode=Mode.FULL, die=None, target=None, **options):
    seen = []

    def hook(table, wave):
        seen.append(wave)
        if len(seen) == die:
            raise RuntimeError("killed")

    source = Watched(spark, f"{path}/source", {"orders": "id"})
    e = SyncEngine(source, target or ParquetCatalog(spark, f"{path}/target"), SyncOptions(tables=("orders",), **options), before_advance=hook)
    (result,) = e.run(mode)
    return e, result


@pytest.mark.parametrize("kind", ["parquet", "warehouse"])
def test_a_killed_copy_goes_on_with_the_files_that_are_left(spark, orders, kind):
    target = WarehouseCatalog(spark, f"w{uuid.uuid4().hex[:8]}") if kind == "warehouse" else None
    e, r = run(spark, orders, die=7, target=target)
    assert r.error == "killed" and len(e.source.read) == 7
    known = e.ledger.get("orders")
    assert (known.status, known.last_pk_value, known.total_rows) == ("failed", None, 6000) and 0 < known.synced_rows < 6000
    files = e.source.files("orders")
    again, r = run(spark, orders, Mode.RESUME, target=target)
    assert r.error is None and r.rows == 6000 and r.copied == 6000 - known.synced_rows and same(again.source, again.target, "orders")
    assert again.source.read == files[6:]  # each file once, but for the wave that wasn't recorded
    assert sum(f.bytes for f in again.source.read) <= 0.6 * sum(f.bytes for f in files)
    assert again.ledger.get("orders").last_pk_value == 5499 and again.ledger.get("orders").status == "done"
    assert run(spark, orders, Mode.RESUME, target=target)[1].skipped


def test_a_wave_opens_its_own_files_only(spark, orders):
    source = ParquetCatalog(spark, f"{orders}/source")
    files = source.files("orders")
    assert len(files) == 12 and sum(f.rows for f in files) == 6000
    rows = source.file_scan("orders", files[2].path, files[4].path)
    assert rows.count() == sum(f.rows for f in files[2:5])
    plan = rows._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().get("numFiles").get().value() == 3


def test_files_that_changed_are_copied_from_the_start(spark, orders):
    run(spark, orders, die=5)
    spark.range(9000, 9100).select("id", F.lit("new").alias("x")).coalesce(1).write.mode("overwrite").parquet(f"{orders}/source/orders.parquet")
    e, r = run(spark, orders, Mode.RESUME)
    assert (r.rows, r.copied, r.error) == (100, 100, None) and same(e.source, e.target, "orders")


def test_files_are_void_after_a_full_run_that_died(spark, orders):
    run(spark, orders)
    e, _ = run(spark, orders, die=1)
    assert Splits(e.target).get("orders") == Files()
    e, r = run(spark, orders, Mode.RESUME)
    assert r.copied == 6000 and same(e.source, e.target, "orders")


def test_a_copy_begun_by_ranges_goes_on_by_ranges(spark, orders):
    e, _ = run(spark, orders)
    log = e.ledger
    log.start("orders", 6000, "id", resumed=False)
    e.target.truncate("orders")
    e.target.write_wave("orders", e.source.range_scan("orders", "id", Chunk(-500, 499), 100), Chunk(-500, 499), "id", 10)
    log.advance("orders", 1000, 499)
    again, r = run(spark, orders, Mode.RESUME)
    assert (r.rows, r.copied) == (6000, 5000) and same(again.source, again.target, "orders") and not again.source.read


def test_null_keys_leave_nothing_of_their_wave(spark, tmp_path):
    spark.createDataFrame([(None, "x"), (1, "y")], "id long, x string").coalesce(1).write.parquet(f"{tmp_path}/source/orders.parquet")
    e, r = run(spark, str(tmp_path))
    assert "1 rows have a null key" in r.error and e.target.load("orders").count() == 0


def test_file_waves_cover_all_files_and_are_alike():
    rng = random.Random(1)
    for n, count in ((1, 16), (5, 16), (40, 16), (1000, 7)):
        files = [SourceFile(f"f{i:04}", rng.randint(1, 100), 1) for i in range(n)]
        found = file_waves(files, count)
        assert [f for wave in found for f in wave] == files and len(found) <= count and all(found)
        if n == 1000:
            sizes = [sum(f.bytes for f in w) for w in found]
            assert max(sizes) < 1.1 * min(sizes)
    assert file_waves([], 3) == []


# Ranges of keys.


def ranges_of(keys, rows_each, most=10_000):
    asked = []

    def histogram(span, width):
        asked.append(width)
        out = {}
        for k in keys:
            if span.start <= k <= span.end:
                out[(k - span.start) // width] = out.get((k - span.start) // width, 0) + 1
        return out

    span = Chunk(min(keys), max(keys))
    found = balanced(span, rows_each, most, histogram)
    assert found[0].start == span.start and found[-1].end == span.end
    assert all(a.end + 1 == b.start for a, b in zip(found, found[1:], strict=False))
    return [sum(c.start <= k <= c.end for k in keys) for c in found], len(asked)


@pytest.mark.parametrize("keys", [
    range(1000), [*range(1000), 10**15], [-(2**63), *range(1000), 2**63 - 1], [x * x for x in range(1000)], [2**i + j for i in range(10, 60) for j in range(20)],
])
def test_ranges_have_like_numbers_of_rows(keys):
    sizes, asked = ranges_of(list(keys), 100)
    assert 9 <= len(sizes) <= 11 and max(sizes) <= 2 * min(sizes) and asked < 40


def test_ranges_keep_a_keys_rows_together_and_are_bounded():
    sizes, _ = ranges_of([7] * 5000 + list(range(100)), 50)
    assert sum(sizes) == 5100 and max(sizes) >= 5000
    assert len(ranges_of(list(range(1000)), 1, most=20)[0]) <= 21
    assert ranges_of([5], 10) == ([1], 1)
    waves = grouped([Chunk(i, i) for i in range(10)], 4)
    assert [(w.start, w.end, len(w.parts)) for w in waves] == [(0, 2, 3), (3, 5, 3), (6, 8, 3), (9, 9, 1)]


@pytest.fixture
def shop(spark):
    """A database whose keys have an outlier, and whose definitions have more than columns."""
    source = derby(spark)
    source.execute(
        """CREATE TABLE "goods" ("id" BIGINT NOT NULL GENERATED BY DEFAULT AS IDENTITY (START WITH 5, INCREMENT BY 5), "name" VARCHAR(40) DEFAULT 'none' NOT NULL,
           "price" DECIMAL(10,2) DEFAULT 1.5, "code" CHAR(8), PRIMARY KEY ("id"))""",
        'CREATE UNIQUE INDEX "by_name" ON "goods" ("name" DESC, "price")',
        'CREATE INDEX "by_price" ON "goods" ("price")',
        'CREATE TABLE "notes" ("n" INTEGER, "text" VARCHAR(40))',
        *[f"INSERT INTO \"goods\" (\"id\", \"name\") VALUES ({i if i < 399 else 10**14}, 'good {i}')" for i in range(400)],
        *[f"INSERT INTO \"notes\" VALUES ({'NULL' if i % 7 == 0 else i - 50}, {'NULL' if i % 5 == 0 else repr('t' * (i % 9))})" for i in range(100)],
    )
    return source


def test_database_ranges_with_an_outlier(spark, shop):
    waves = shop.key_waves("goods", "id", Chunk(0, 10**14), 50, None)
    assert len(waves) == 4 and sum(len(w.parts) for w in waves) == 8
    sizes = [n for w in waves for n in shop.range_scan("goods", "id", w, 50).groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert sum(sizes) == 400 and max(sizes) <= 2 * min(sizes)


def test_database_rows_come_in_the_keys_order(spark, shop, tmp_path):
    rows = shop.range_scan("goods", "id", Wave(0, 399, (Chunk(0, 199), Chunk(200, 399))), 50)
    for part in rows.select("id").rdd.mapPartitions(lambda x: [[r.id for r in x]]).collect():
        assert part == sorted(part) and part
    target = ParquetCatalog(spark, str(tmp_path / "t"))
    plans = []
    write = target.write_wave
    target.write_wave = lambda table, part, *more: (plans.append(part._jdf.queryExecution().executedPlan().toString()), write(table, part, *more))
    e = SyncEngine(shop, target, SyncOptions(tables=("goods",), sort_rows=True, chunk_size=100))
    assert [r.error for r in e.run()] == [None] and same(shop, target, "goods")
    assert plans and not any("Sort" in p for p in plans)


# Tables of a database without a key.


def test_unkeyed_rows_are_read_by_buckets(spark, shop):
    e = SyncEngine(shop, derby(spark), SyncOptions(tables=("notes",), chunk_size=20, batch_insert_size=17))
    rows = shop.bulk_scan("notes", 100, 20)
    assert rows.rdd.getNumPartitions() == 4 and shop._options()["fetchsize"] == "17"
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, shop.load("notes").collect()))
    assert len({r[0] for r in rows.select(F.spark_partition_id()).collect()}) > 1
    assert [(r.rows, r.error) for r in e.run()] == [(100, None)] and same(shop, e.target, "notes")
    assert shop.bulk_scan("notes", 10, 20).rdd.getNumPartitions() == 1
    mysql = JdbcCatalog.of(None, {"host": "h", "port": 1, "user": "u", "password": "p", "database": "d"}, {})
    assert mysql.bucket(shop.load("notes").schema, 4) == "MOD(CRC32(CONCAT_WS('#', `n`, `text`)), 4)"


# Definitions.


def test_definitions_are_carried_over(spark, shop):
    target = derby(spark)
    e = SyncEngine(shop, target, SyncOptions(chunk_size=100))
    assert all(r.error is None for r in e.run()) and same(shop, target, "goods")
    ours, theirs = target.definition("goods"), shop.definition("goods")
    assert ours.columns[1:] == theirs.columns[1:] and ours.key == ("id",) and ours.indexes == theirs.indexes
    assert [c.default for c in ours.columns[1:3]] == ["'none'", "1.5"] and ours.columns[3].type == "CHAR(8)" and ours.columns[0].identity[1] == 5
    assert ours.indexes == (ddl.IndexDef("by_name", True, (("name", False), ("price", True))), ddl.IndexDef("by_price", False, (("price", True),)))
    target.execute('INSERT INTO "goods" ("name") VALUES (\'next\')')
    assert target.load("goods").where("name = 'next'").first()["id"] == 10**14 + 5  # it goes on behind the copied keys
    assert "GENERATED BY DEFAULT AS IDENTITY" in target.ddl("goods") and 'CREATE UNIQUE INDEX "by_name"' in target.ddl("goods")


def test_types_as_text():
    assert [ddl.type_text(*x) for x in (("VARCHAR", 40, 0), ("DECIMAL", 10, 2), ("BIGINT", 19, 0), ("CHAR () FOR BIT DATA", 8, 0))] == ["VARCHAR(40)", "DECIMAL(10,2)", "BIGINT", "CHAR (8) FOR BIT DATA"]


# Replacing a database's table.


@pytest.mark.parametrize("at", ["_append", "first", "second", None])
def test_a_replacement_keeps_old_or_new_rows_whole(spark, shop, monkeypatch, at):
    target, rows = shop, shop.load("notes").limit(30)
    before = shop.definition("goods")
    renamed = []
    rename = target._rename

    def breaking(table, name):
        renamed.append(name)
        if at == ("first", "second")[min(len(renamed), 2) - 1] and len(renamed) <= 2:
            raise OSError("no")
        rename(table, name)

    monkeypatch.setattr(target, "_rename", breaking)
    if at == "_append":
        monkeypatch.setattr(target, "_append", lambda *a: (_ for _ in ()).throw(OSError("no")))
    if at is None:
        target.replace("notes", rows, 10)
        assert target.load("notes").count() == 30
        target.replace("goods", target.load("goods").where("id < 10"), 10)
        assert target.load("goods").count() == 10
        after = target.definition("goods")
        assert after.key == before.key and after.columns[1:] == before.columns[1:] and [x.columns for x in sorted(after.indexes, key=lambda x: not x.unique)] == [x.columns for x in before.indexes]
    else:
        with pytest.raises(OSError):
            target.replace("notes", rows, 10)
        assert target.load("notes").count() == 100
    assert target.tables() == ["goods", "notes"]


def test_a_replacement_that_died_is_undone(spark, shop):
    """As a killed driver leaves it: between the two renamings, and before the old rows are dropped."""
    shop._rename("notes", "notes__old")
    shop.execute('CREATE TABLE "notes__new" ("n" INTEGER, "text" VARCHAR(40))')
    shop.recover("notes")
    assert shop.tables() == ["goods", "notes"] and shop.load("notes").count() == 100
    shop.execute('CREATE TABLE "notes__old" ("n" INTEGER)')
    shop.recover("notes")
    assert shop.tables() == ["goods", "notes"] and shop.load("notes").count() == 100


# Keys that repeat.


def test_repeated_keys_with_and_without_a_shuffle(spark):
    rng = random.Random(2)
    keys = [rng.randint(0, 300) for _ in range(500)] + [7] * 100
    want = len(keys) - len(set(keys))
    rows = spark.createDataFrame([(k,) for k in keys] + [(None,)] * 3, "id long")
    ordered = rows.repartitionByRange(4, "id").sortWithinPartitions("id")
    flat = spark.createDataFrame([(k,) for k in sorted(keys)], "id long")  # a key lies across the ends of tasks
    assert [repeated_keys(x, "id") for x in (rows, ordered, flat, rows.distinct(), rows.limit(0))] == [want, want, want, 0, 0]
    assert repeated_keys(rows.select(F.col("id").cast("string").alias("a`b")), "a`b") == want


def test_keys_that_rise_are_not_shuffled(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "groupBy", lambda *a: (_ for _ in ()).throw(AssertionError("grouped")))
    assert repeated_keys(spark.read.parquet(str(tmp_path / "t")), "id") == 0


def test_a_key_that_must_not_repeat(spark, orders):
    e, r = run(spark, orders, unique=("orders",))
    assert r.error is None
    spark.createDataFrame([(5, "again"), (6, "again")], "id long, x string").coalesce(1).write.mode("append").parquet(f"{orders}/source/orders.parquet")
    e, r = run(spark, orders, unique=("orders",))
    assert "the key id repeats: 2 rows" in r.error and e.ledger.get("orders").status == "failed"
    assert run(spark, orders)[1].error is None


# Progress.


def test_running_copies_are_reported(spark, tmp_path, caplog):
    slow = F.udf(lambda x: (time.sleep(0.4), x)[1], "long")
    spark.range(20).write.parquet(str(tmp_path / "source" / "t.parquet"))
    source = ParquetCatalog(spark, str(tmp_path / "source"))
    full = source.full_scan
    source.full_scan = lambda table: full(table).repartition(2).select(slow("id").alias("id"))
    with caplog.at_level(logging.INFO):
        (r,) = SyncEngine(source, ParquetCatalog(spark, str(tmp_path / "target")), interval=0.5).run()
    said = [m for m in caplog.messages if "running tasks done" in m]
    assert r.error is None and len(said) >= 2 and "table t: 0 of 20 rows committed" in said[-1] and any(not m.split("), ")[1].startswith("0 of 0 ") for m in said)
