import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.config import SyncOptions
from tidemark.model import Chunk, Mode
from tidemark.operators import SyncEngine, reconcile
from tidemark.sources import JdbcCatalog, ParquetCatalog, WarehouseCatalog
from tidemark.streaming import follow_files

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def derby(spark, keys=None):
    return JdbcCatalog(spark, f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", DERBY, None, keys)


@pytest.fixture
def shop(spark):
    source = derby(spark)
    source.execute(
        'CREATE TABLE "goods" ("id" BIGINT NOT NULL, "name" VARCHAR(40), "price" DECIMAL(10,2), "seen" TIMESTAMP, PRIMARY KEY ("id"))',
        'CREATE TABLE "lines" ("order" INTEGER NOT NULL, "line" INTEGER NOT NULL, "n" INTEGER, PRIMARY KEY ("order", "line"))',
        'CREATE TABLE "notes" ("text" VARCHAR(40))',
        *[f"INSERT INTO \"goods\" VALUES ({i}, 'good {i}', {i}.25, TIMESTAMP('2024-01-01 00:00:00.123456'))" for i in range(-5, 20)],
        *[f'INSERT INTO "lines" VALUES ({i // 4}, {i % 4}, {i})' for i in range(20)],
        *["INSERT INTO \"notes\" VALUES ('same')"] * 3,
        'CREATE VIEW "cheap" AS SELECT * FROM "goods" WHERE "price" < 3',
    )
    return source


def same(source, target, table):
    return tuple(reconcile(source.load(table), target.load(table).select(*source.load(table).columns)).first())[2:] == (0, 0)


def test_metadata(shop):
    assert shop.discover() == ["goods", "lines", "notes"]
    assert (shop.key("goods"), shop.key("lines"), shop.key("notes")) == ("id", "order", None)
    assert shop.key_columns("lines") == ["order", "line"]
    assert shop.columns("lines") == ["order", "line", "n"]
    assert '"name" VARCHAR(40)' in shop.ddl("goods") and 'PRIMARY KEY ("id")' in shop.ddl("goods")


def test_range_scan_is_a_query_for_each_chunk(shop):
    rows = shop.range_scan("goods", "id", Chunk(0, 11), 4)
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in rows.collect()) == list(range(12))


def test_database_to_folder_and_back(spark, shop, tmp_path):
    folder = ParquetCatalog(spark, str(tmp_path / "t"))
    options = SyncOptions(chunk_size=6)
    assert all(r.error is None for r in SyncEngine(shop, folder, options).run())
    assert all(same(shop, folder, t) for t in shop.discover())
    back = derby(spark)
    folder.keys = {"goods": "id", "lines": "order"}
    assert [r.error for r in SyncEngine(folder, back, options).run()] == [None] * 3
    assert all(same(shop, back, t) for t in shop.discover())


def test_database_to_database_keeps_keys_and_resumes(spark, shop):
    target, seen = derby(spark), []

    def die(table, wave):
        seen.append(wave)
        if table == "goods" and len(seen) == 2:
            raise RuntimeError("killed")

    options = SyncOptions(chunk_size=5, tables=("goods",), parallel_tables=1)
    assert SyncEngine(shop, target, options, before_advance=die).run()[0].error == "killed"
    assert SyncEngine(shop, target, options).run(Mode.RESUME)[0].rows == 25
    assert same(shop, target, "goods") and target.key_columns("goods") == ["id"]
    assert SyncEngine(shop, target, options).run()[0].rows == 25 and same(shop, target, "goods")
    assert target.key_columns("goods") == ["id"]
    with pytest.raises(Exception, match="(?i)duplicate|batch"):
        target.append("goods", shop.load("goods").limit(1))


def test_unkeyed_database_table_is_replaced(spark, shop):
    target = derby(spark)
    for _ in range(2):
        assert SyncEngine(shop, target, SyncOptions(tables=("notes",))).run(Mode.RESUME)[0].rows == 3
    assert target.load("notes").count() == 3


def test_mysql_url():
    s = {"host": "h", "port": 3307, "user": "u", "password": "p", "database": "d b", "charset": "utf8mb4"}
    c = JdbcCatalog.of(None, s, {})
    assert c.url.startswith("jdbc:mysql://h:3307/d%20b?characterEncoding=UTF-8") and c.quoted("a`b") == "`a``b`" and c.properties == {"user": "u", "password": "p"}
    for setting in ("zeroDateTimeBehavior=EXCEPTION", "useCursorFetch=true", "rewriteBatchedStatements=true"):
        assert setting in c.url


def test_warehouse(spark, shop, tmp_path):
    target = WarehouseCatalog(spark, f"w{uuid.uuid4().hex[:8]}")
    seen = []

    def die(table, wave):
        seen.append(wave)
        if len(seen) == 3:
            raise RuntimeError("killed")

    options = SyncOptions(chunk_size=6, parallel_tables=1)
    SyncEngine(shop, target, options, before_advance=die).run()
    assert all(r.error is None for r in SyncEngine(shop, target, options).run(Mode.RESUME))
    assert all(same(shop, target, t) for t in shop.discover())
    assert target.key("goods") == "id" and target.discover() == shop.discover()
    spark.sql(f"CREATE TABLE {target.database}.foreign_ AS SELECT 1 AS a")
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "s" / "foreign_.parquet"))
    assert "not written" in SyncEngine(ParquetCatalog(spark, str(tmp_path / "s")), target, SyncOptions(tables=("foreign_",))).run()[0].error
    spark.sql(f"DROP DATABASE {target.database} CASCADE")


def test_following_files(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("s", "t", "c"))
    spark.range(10).write.parquet(source)
    assert follow_files(spark, source, target, check) == 10
    assert follow_files(spark, source, target, check) == 0
    spark.range(10, 15).write.mode("append").parquet(source)
    assert follow_files(spark, source, target, check) == 5
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(15))


def test_the_database_answers_for_its_key_range(spark, shop):
    stats = shop.key_stats("goods", "id")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "MIN(" in plan and "Aggregate" not in plan and stats.count() == 1
    rows = shop.load("goods")
    assert tuple(stats.first()) == (rows.agg({"id": "min"}).first()[0], rows.agg({"id": "max"}).first()[0], rows.count(), rows.count())
    assert shop.count("goods") == rows.count() and shop.exists("goods") and not shop.exists("good_") and not shop.exists("%")


def test_a_target_folder_keeps_its_key(spark, tmp_path):
    schema = spark.createDataFrame([], "a long, b string").schema
    target = ParquetCatalog(spark, str(tmp_path))
    target.create("t", schema, "a")
    target.create("u", schema, None, ["b", "a"])
    target.create("v", schema, None)
    again = ParquetCatalog(spark, str(tmp_path))
    assert [again.key(t) for t in "tuv"] == ["a", "b", None] and again.key_columns("u") == ["b", "a"]
    again.replace("u", spark.createDataFrame([(1, "x")], schema), 10)
    assert again.key_columns("u") == ["b", "a"] and again.load("u").count() == 1


def test_a_replacement_that_fails_loses_nothing(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "a long").schema
    target = ParquetCatalog(spark, str(tmp_path))
    target.create("t", schema, None)
    target.replace("t", spark.range(5).toDF("a"), 10)
    move = target.hdfs.move

    def broken(old, new):
        if "/_stage_" in old and new == target.place("t"):
            raise OSError("no")
        move(old, new)

    monkeypatch.setattr(target.hdfs, "move", broken)
    with pytest.raises(OSError):
        target.replace("t", spark.range(7).toDF("a"), 10)
    assert target.load("t").count() == 5 and [n for n in target.hdfs.names(str(tmp_path)) if n.startswith("_stage_t_")] and target.tables() == ["t"]


def test_a_failed_load_leaves_the_database_table(spark, shop):
    before = shop.load("goods").count()
    bad = shop.load("goods").withColumn("id", F.lit(None).cast("long"))
    with pytest.raises(Exception):  # noqa: B017  whatever the database says
        shop.replace("goods", bad, 10)
    assert shop.load("goods").count() == before and not [t for t in shop.tables() if t.lower().startswith("stage_")]
