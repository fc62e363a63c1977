"""Comparing tables by sums of row hashes, and attempts that are made again."""

import datetime
import decimal
import random
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.cli import main
from tidemark.config import ConfigError, SyncOptions
from tidemark.model import Mode
from tidemark.operators import SyncEngine, reconcile, verify
from tidemark.operators.retry import passes, pause
from tidemark.operators.verify import MOST_PARTS, _Parts, part_sums
from tidemark.sources import JdbcCatalog, ParquetCatalog

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def counts(c):
    return c.source_rows, c.target_rows, c.missing_rows, c.extra_rows


def keyed(spark, ids):
    return spark.createDataFrame([(i, f"row {i}") for i in ids], "id long, x string")


# Comparing.


@pytest.mark.parametrize("key", ["id", None])
def test_equal_and_damaged(spark, key):
    a = keyed(spark, range(3000)).repartition(5)
    assert counts(verify(a, keyed(spark, range(3000)).repartition(3), key)) == (3000, 3000, 0, 0)
    b = a.where("id <> 7").union(a.where("id = 2999")).withColumn("x", F.when(F.col("id") == 100, "other").otherwise(F.col("x")))
    found = verify(a, b, key)
    assert counts(found) == (3000, 3000, 2, 2) == tuple(reconcile(a, b).first())
    assert 0 < found.differing < found.parts and not found.same
    if key:
        assert found.spans == ((7, 7), (100, 100), (2999, 2999))


def test_nothing_of_equal_tables_is_shuffled_but_sums(spark):
    a = keyed(spark, range(100))
    renamed = a.toDF("c0", "c1")
    plan = part_sums(renamed, renamed, _Parts(renamed, renamed, "c0"))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sent and all("hashpartitioning(part#" in line.replace("_groupingexpression", "part") for line in sent)
    assert "c1" not in plan.split("Exchange hashpartitioning")[0]


@pytest.mark.parametrize("low, high", [(-(2**63), 2**63 - 1), (2**63 - 10, 2**63 - 1), (-5, 2**62), (0, 0)])
def test_far_keys(spark, low, high):
    ids = sorted({low, high, (low + high) // 2})
    found = verify(keyed(spark, ids), keyed(spark, ids[:-1]), "id")
    assert counts(found) == (len(ids), len(ids) - 1, 1, 0)
    assert found.parts <= MOST_PARTS and found.spans[0][0] <= high <= found.spans[0][1]


def test_keys_outside_the_sources_and_decimals(spark):
    a, b = keyed(spark, range(10, 20)), keyed(spark, range(5, 25))
    assert counts(verify(a, b, "id")) == (10, 20, 0, 10)
    wide = [decimal.Decimal(10**30 + i) for i in range(50)]
    kind = "id decimal(38,0)"
    assert counts(verify(spark.createDataFrame([(i,) for i in wide], kind), spark.createDataFrame([(i,) for i in wide[1:]], kind), "id")) == (50, 49, 1, 0)


def test_null_keys_empty_tables_and_names(spark):
    kind = "id long, `h0` string, `part` string, `a.b ``c` string, PART2 string"
    a = spark.createDataFrame([(None, "x", "y", "z", "w"), (1, None, None, None, None)], kind)
    assert counts(verify(a, a, "id")) == (2, 2, 0, 0)
    found = verify(a, a.where("id = 1").select("part", "h0", "id", "`a.b ``c`", "part2"), "id")
    assert counts(found) == (2, 1, 1, 0) and found.spans == ((None, None),)
    none = spark.createDataFrame([], kind)
    assert counts(verify(none, none, "id")) == (0, 0, 0, 0) and verify(none, none).same
    assert counts(verify(none, a, "id")) == (0, 2, 0, 2)
    with pytest.raises(ValueError, match="columns differ: part2"):
        verify(a, a.drop("part2"), "id")


def test_values_that_a_plain_hash_takes_for_the_same(spark):
    pairs = [
        ("a string, b string", (None, "x"), ("x", None)),
        ("a double", (0.0,), (-0.0,)),
        ("a array<array<int>>", ([[1], [2]],), ([[1, 2], []],)),
        ("a array<int>", ([None],), ([],)),
        ("a array<int>", (None,), ([],)),
        ("a struct<x: int, y: int>", ((None, 1),), ((1, None),)),
        ("a struct<x: int>", (None,), ((None,),)),
        ("a map<string, int>", ({"k": None},), ({},)),
        ("a string, b string", ("ab", "c"), ("a", "bc")),
    ]
    for kind, x, y in pairs:
        a, b = spark.createDataFrame([x], kind), spark.createDataFrame([y], kind)
        assert counts(verify(a, b)) == (1, 1, 1, 1), (kind, x, y)
        assert verify(a, a).same
    a = spark.createDataFrame([({"k": 1, "l": 2}, datetime.date(2020, 1, 1), b"\0", float("nan"))], "a map<string, int>, d date, e binary, f double")
    assert verify(a, spark.createDataFrame([({"l": 2, "k": 1}, datetime.date(2020, 1, 1), b"\0", float("nan"))], a.schema)).same


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50) | st.none(), st.sampled_from(["a", "b", None, ""])), max_size=30), st.integers(0, 2**32))
def test_any_two_bags(spark, rows, seed):
    kind, rng = "id int, x string", random.Random(seed)
    other = [r for r in rows if rng.random() < 0.8] + [r for r in rows if rng.random() < 0.2]
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    for key in ("id", None):
        assert counts(verify(a, b, key)) == tuple(reconcile(a, b).first())


def test_a_copy_that_is_not_its_source_fails(spark, tmp_path, monkeypatch):
    keyed(spark, range(50)).write.parquet(f"{tmp_path}/s/t.parquet")

    def make(**more):
        return SyncEngine(ParquetCatalog(spark, f"{tmp_path}/s", {"t": "id"}), ParquetCatalog(spark, f"{tmp_path}/t"), SyncOptions(**more))

    (r,) = make(verify=True).run()
    assert r.error is None and make().verify()["t"].same
    write = ParquetCatalog.write_wave
    monkeypatch.setattr(ParquetCatalog, "write_wave", lambda self, table, rows, *a: write(self, table, rows.where("id <> 3"), *a))
    e = make(verify=True)
    (r,) = e.run()
    assert "1 rows are missing in the target and 0 are in it alone, in 1 of 50 parts" == r.error
    assert e.ledger.get("t").status == "failed" and e.verify()["t"].spans == ((3, 3),)


def test_command_line(spark, tmp_path):
    keyed(spark, range(50)).write.parquet(f"{tmp_path}/s/t.parquet")
    (tmp_path / "c.yaml").write_text(f"source: {{path: {tmp_path}/s}}\ntarget: {{path: {tmp_path}/t}}\nsync: {{keys: {{t: id}}, verify: true}}\n")
    run = lambda *more: main(["-c", str(tmp_path / "c.yaml"), *more], spark)
    assert run("--verify") == 1  # not there yet
    assert run() == 0 and run("--verify") == 0
    keyed(spark, [99]).write.mode("append").parquet(f"{tmp_path}/s/t.parquet")
    assert run("--verify") == 1


def test_databases_are_compared_with_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", i / 3, i % 2 == 0) for i in range(90)], "id int, name string, x double, even boolean")
    rows.write.parquet(f"{tmp_path}/s/keyed.parquet")
    rows.drop("id").write.parquet(f"{tmp_path}/s/loose.parquet")
    target = JdbcCatalog(spark, f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true", DERBY, None, {"keyed": "id"})
    e = SyncEngine(ParquetCatalog(spark, f"{tmp_path}/s", {"keyed": "id"}), target, SyncOptions(chunk_size=20, verify=True))
    assert [r.error for r in e.run()] == [None, None]
    assert {t: counts(c) for t, c in e.verify().items()} == {"keyed": (90, 90, 0, 0), "loose": (90, 90, 0, 0)}
    target.execute(f"DELETE FROM {target.name('keyed')} WHERE {target.quoted('id')} = 41", f"DELETE FROM {target.name('loose')} WHERE CAST({target.quoted('name')} AS VARCHAR(9)) = 'n41'")
    assert {t: counts(c) for t, c in e.verify().items()} == {"keyed": (90, 89, 1, 0), "loose": (90, 89, 1, 0)}


# Attempts that are made again.


class Failing(ParquetCatalog):
    """Writes the rows and then fails, so many times."""

    def __init__(self, *args, times, error):
        super().__init__(*args)
        self.left, self.error = times, error

    def _maybe(self):
        if self.left:
            self.left -= 1
            raise self.error

    def write_wave(self, *args):
        super().write_wave(*args)
        self._maybe()

    def replace(self, *args):
        super().replace(*args)
        self._maybe()


def engine(spark, path, times, error=None, key="id", **more):
    target = Failing(spark, f"{path}/t", times=times, error=error or ConnectionResetError("reset by peer"))
    return SyncEngine(ParquetCatalog(spark, f"{path}/s", {"t": key}), target, SyncOptions(**{"retry_seconds": 0, **more}))


@pytest.mark.parametrize("key", ["id", None])
def test_a_write_that_fails_twice_is_made_again(spark, tmp_path, key):
    keyed(spark, range(80)).repartition(4).write.parquet(f"{tmp_path}/s/t.parquet")
    e = engine(spark, tmp_path, 2, key=key)
    (r,) = e.run()
    assert (r.error, r.rows, r.copied, r.retries) == (None, 80, 80, 2)
    assert verify(e.source.load("t"), e.target.load("t"), "id").same
    said = e.retries.fold().first()
    assert (said["table_name"], said["retries"], said["error"]) == ("t", 2, "reset by peer")
    p = e.ledger.get("t")
    assert (p.status, p.synced_rows) == ("done", 80) and e.retries.get("t") == 2
    assert type(e.retries)(e.target).get("t") == 2  # a later run reads it


def test_too_many_failures_and_lasting_ones(spark, tmp_path):
    keyed(spark, range(20)).write.parquet(f"{tmp_path}/s/t.parquet")
    e = engine(spark, tmp_path, 4, retries=3)
    (r,) = e.run()
    assert (r.error, r.retries, e.ledger.get("t").status) == ("reset by peer", 3, "failed")
    (r,) = e.run(Mode.RESUME)
    assert (r.error, r.rows, r.retries) == (None, 20, 0)
    e = engine(spark, tmp_path, 1, ValueError("wrong"))
    (r,) = e.run()
    assert (r.error, r.retries, e.target.left) == ("wrong", 0, 0)
    (r,) = engine(spark, tmp_path, 1, retries=0).run()
    assert r.error == "reset by peer"


def test_no_log_without_a_failure(spark, tmp_path):
    keyed(spark, range(20)).write.parquet(f"{tmp_path}/s/t.parquet")
    e = engine(spark, tmp_path, 0)
    assert [r.retries for r in e.run()] == [0] and not e.target.exists("sync_retries")
    e = engine(spark, tmp_path, 1)
    e.run()
    assert e.target.exists("sync_retries") and e.target.discover() == ["t"]


def java(spark, name, *args):
    at = spark._jvm
    for part in name.split("."):
        at = getattr(at, part)
    return at(*args)


class Told(RuntimeError):
    def __init__(self, origin, text=""):
        super().__init__(text)
        self._origin = origin


def test_which_errors_pass(spark):
    sql = lambda name, *a: Told(java(spark, f"java.sql.{name}", *a))
    assert passes(sql("SQLTransientConnectionException", "gone"))
    assert passes(sql("SQLRecoverableException", "gone"))
    assert passes(sql("SQLException", "deadlock", "40001")) and passes(sql("SQLException", "link", "08S01"))
    assert not passes(sql("SQLException", "unknown", "42X05"))
    assert not passes(sql("SQLSyntaxErrorException", "no such table"))
    assert not passes(sql("SQLIntegrityConstraintViolationException", "duplicate", "23505"))
    wrapped = java(spark, "java.lang.RuntimeException", "write failed", java(spark, "java.net.SocketTimeoutException", "slow"))
    assert passes(Told(wrapped))
    assert passes(Told(None, "Job aborted due to stage failure: java.sql.SQLTransientConnectionException: gone"))
    assert not passes(Told(None, "Job aborted due to stage failure: java.sql.SQLIntegrityConstraintViolationException: java.io.IOException"))
    assert not passes(ValueError("no")) and passes(TimeoutError()) and passes(ConnectionResetError())
    try:
        raise RuntimeError("outer") from ConnectionResetError("x")
    except RuntimeError as e:
        assert not passes(e)  # what Python raised of its own accord; only named causes count
    with pytest.raises(AnalysisException) as missing:
        spark.table("no_such_table_at_all")
    assert not passes(missing.value)


def test_waits_grow_to_a_bound():
    for n, most in ((1, 2), (2, 4), (3, 8), (20, 60)):
        assert all(most / 2 <= pause(n, 2.0) <= most for _ in range(50))
    assert pause(3, 0) == 0


@pytest.mark.parametrize("bad", [{"retries": -1}, {"retries": True}, {"retry_seconds": -1}, {"retry_seconds": float("nan")}, {"verify": 1}])
def test_options(bad):
    with pytest.raises(ConfigError):
        SyncOptions(**bad)
