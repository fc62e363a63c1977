"""Registered queries of the copy engine over the fixture tables, and their DuckDB equivalents.

Each query that copies does so into a new folder and reads its rows from there.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import SyncOptions
from .model import Chunk, Mode
from .functions import percent, rate
from .operators import SyncEngine, batch_report, chunk_report, reconcile, summary, verify
from .operators.scan import key_range, key_range_frame
from .operators.unique import repeated_keys
from .plans import first_key, waves
from .sources import ParquetCatalog, WarehouseCatalog
from .sources.files import Files

#: Parquet keeps no keys, so they are configured.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None,
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}
CHUNK = 500


class Interrupted(RuntimeError):
    """Stands for a run that is killed between a wave's commit and its entry in the ledger."""


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one on a single machine. It goes when the session's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = f"{shared}/tidemark-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidemark-")
    Files(spark).forget_at_exit(made)
    return made


def source(spark: SparkSession, sf_dir: str) -> ParquetCatalog:
    return ParquetCatalog(spark, sf_dir, KEYS)


def engine(spark: SparkSession, sf_dir: str, *tables: str, chunk_size: int = CHUNK, **more) -> SyncEngine:
    return SyncEngine(source(spark, sf_dir), ParquetCatalog(spark, scratch(spark), KEYS), SyncOptions(chunk_size=chunk_size, tables=tables), **more)


def _run(e: SyncEngine, mode: Mode = Mode.FULL) -> SyncEngine:
    for r in e.run(mode):
        if r.error is not None:
            raise RuntimeError(f"{r.table}: {r.error}")
    return e


def copied(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return _run(engine(spark, sf_dir, table, chunk_size=50_000)).target.load(table)


def copy_to_warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, by way of a database of the Spark catalog: there and back to files."""
    database = f"tidemark_{uuid.uuid4().hex[:12]}"
    warehouse = WarehouseCatalog(spark, database, KEYS)
    options = SyncOptions(chunk_size=10, tables=("nation",))
    _run(SyncEngine(source(spark, sf_dir), warehouse, options))
    back = _run(SyncEngine(warehouse, ParquetCatalog(spark, scratch(spark)), options)).target.load("nation")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return back


def _resumed(spark: SparkSession, sf_dir: str) -> SyncEngine:
    """A copy of orders, stored in eight files first, with a run that dies after its fifth wave is written and before it is recorded; resumed. All with default options."""
    files = ParquetCatalog(spark, scratch(spark), KEYS)
    source(spark, sf_dir).load("orders").repartition(8).write.parquet(files.place("orders"))
    seen: list[Chunk] = []

    def die(table: str, wave: Chunk) -> None:
        seen.append(wave)
        if len(seen) == 5:
            raise Interrupted(table)

    options = SyncOptions(tables=("orders",))
    e = SyncEngine(files, ParquetCatalog(spark, scratch(spark), KEYS), options, before_advance=die)
    if [r.error for r in e.run()] != ["orders"]:
        raise AssertionError("the run should have been interrupted")
    return _run(SyncEngine(e.source, e.target, options), Mode.RESUME)


def copy_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir).target.load("orders")


def resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the record of copied files says after that."""
    return _resumed(spark, sf_dir).splits.fold().select("table_name", "files", "rows", F.col("high").cast("long").alias("high"))


def copy_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels: copied, its progress forgotten, resumed. Nothing counts as committed, so all is copied again."""
    e = _run(engine(spark, sf_dir, "labels", chunk_size=100))
    e.ledger.reset("labels")
    return _run(e, Mode.RESUME).target.load("labels")


def copy_unkeyed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _run(engine(spark, sf_dir, "lineitem"))
    return _run(e, Mode.RESUME).target.load("lineitem")


def key_range_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return key_range_frame(source(spark, sf_dir).load(table), KEYS[table])


def key_range_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_range_frame(source(spark, sf_dir).load("orders").where(F.col("o_orderkey") < 0), "o_orderkey")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir)
    counts = [s.load(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in KEYS]
    return functools.reduce(DataFrame.union, counts)


def columns_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    names = source(spark, sf_dir).columns(table)
    return spark.createDataFrame([(c, i) for i, c in enumerate(names, 1)], "column_name string, ordinal_position int")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in source(spark, sf_dir).discover()], "table_name string")


def _chunk_scans(spark: SparkSession, sf_dir: str, table: str, count: int) -> list[DataFrame]:
    """Scans of a table, one for each of at most `count` waves of chunks that cover its keys."""
    s, key = source(spark, sf_dir), KEYS[table]
    keys = key_range(s.load(table), key)
    return [s.range_scan(table, key, c, 100) for c in waves(keys.low, keys.high, 100, count)]


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels by ten range scans: every row is in one of them."""
    return functools.reduce(DataFrame.union, _chunk_scans(spark, sf_dir, "labels", 10))


def chunk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_report(source(spark, sf_dir).load("labels"), "doc_id", 100)


def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_report(source(spark, sf_dir).load("labels"), "doc_id", 100, 16)


def composite_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for each leading key of each chunk of a table with a composite key: none is split, or it would come twice."""
    turns = [F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")]
    return functools.reduce(DataFrame.union, [rows.groupBy("conv_id").agg(*turns) for rows in _chunk_scans(spark, sf_dir, "conversations", 10)])


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to read of orders after key 7999 is committed."""
    s = source(spark, sf_dir)
    keys = key_range(s.load("orders"), "o_orderkey")
    return s.range_scan("orders", "o_orderkey", Chunk(first_key(keys, 7999), keys.high), CHUNK)


SYNCED = ("region", "nation", "supplier", "labels", "conversations")


def progress_after_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _run(engine(spark, sf_dir, *SYNCED))
    return e.ledger.progress().select("table_name", "total_rows", "synced_rows", "primary_key", F.col("last_pk_value").cast("long").alias("last_pk_value"), "status")


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a resumed run: two tables are complete already, the others are copied."""
    first = _run(engine(spark, sf_dir, *SYNCED[:2]))
    again = SyncEngine(first.source, first.target, SyncOptions(chunk_size=CHUNK, tables=SYNCED))
    return summary(spark, again.run(Mode.RESUME))


def _with_a_bad_table(spark: SparkSession, sf_dir: str) -> tuple[SyncEngine, list]:
    e = engine(spark, sf_dir, "region", "no_such_table", "nation")
    return e, e.run()


def failure_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a run with a table that can't be read: it alone failed."""
    e, _ = _with_a_bad_table(spark, sf_dir)
    return e.ledger.progress().select("table_name", "status", "synced_rows", F.col("error").isNotNull().alias("has_error"))


def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, _with_a_bad_table(spark, sf_dir)[1])


def restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run that restarts: what was complete is copied again."""
    first = _run(engine(spark, sf_dir, *SYNCED))
    return summary(spark, first.run(Mode.RESTART))


def progress_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chunk of labels: the percentage of rows copied once it is, and rows a second if each chunk takes a quarter of one; 0 before the first."""
    report = chunk_ledger(spark, sf_dir)
    total, seconds = F.lit(source(spark, sf_dir).count("labels")), F.col("chunk_id") * 0.25
    return report.select("chunk_id", percent(F.col("synced_rows"), total).alias("percent"), rate(F.col("synced_rows"), seconds).alias("rows_per_second"), percent(F.col("synced_rows"), F.lit(0)).alias("of_nothing"))


def sorted_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels copied with sort_rows: rows, and those that stand behind a larger key in their file."""
    e = SyncEngine(source(spark, sf_dir), ParquetCatalog(spark, scratch(spark)), SyncOptions(chunk_size=CHUNK, sort_rows=True, tables=("labels",)))
    rows = _run(e).target.load("labels").select("doc_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    late = F.lag("doc_id").over(W.partitionBy("file").orderBy("at")) > F.col("doc_id")
    return rows.select(late.alias("late")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("late_rows"))


def copied_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that a target knows of its own, after copies from a source with configured ones."""
    target = ParquetCatalog(spark, _run(engine(spark, sf_dir, *SYNCED, "lineitem")).target.root)
    return spark.createDataFrame([(t, target.key(t)) for t in (*SYNCED, "lineitem")], "table_name string, primary_key string")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table's leading key, and of a column that is none, the rows whose key another row has already."""
    s = source(spark, sf_dir)
    found = [(t, k, repeated_keys(s.load(t), k)) for t, k in (KEYS | {"lineitem": "l_orderkey"}).items()]
    return spark.createDataFrame(found, "table_name string, key_column string, repeated_rows long")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _run(engine(spark, sf_dir, *SYNCED, "lineitem"))
    rows = [reconcile(e.source.load(t), e.target.load(t)).select(F.lit(t).alias("table_name"), "*") for t in (*SYNCED, "lineitem")]
    return functools.reduce(DataFrame.union, rows)


def _comparison(spark: SparkSession, found: dict) -> DataFrame:
    rows = [(t, c.differing, c.source_rows, c.target_rows, c.missing_rows, c.extra_rows) for t, c in found.items()]
    return spark.createDataFrame(rows, "table_name string, differing_parts long, source_rows long, target_rows long, missing_rows long, extra_rows long")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables: copied, then compared with their sources by sums of row hashes."""
    e = _run(engine(spark, sf_dir, *KEYS, chunk_size=50_000))
    found = e.verify()
    for c in found.values():
        if isinstance(c, Exception):
            raise c
    return _comparison(spark, found)


def verified_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, by its key, and lineitem, without one, against tables where rows are changed, missing and there twice."""
    s = source(spark, sf_dir)
    o, l = s.load("orders"), s.load("lineitem")
    bad = o.where(F.col("o_orderkey") % 1009 != 5).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1009 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    twice = l.union(l.where(F.col("l_orderkey") % 997 == 3))
    found = {"orders": verify(o, bad.union(o.where(F.col("o_orderkey") % 1009 == 9)), "o_orderkey"), "lineitem": verify(l, twice)}
    return _comparison(spark, found).drop("differing_parts")


def damaged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of orders' keys in which a table differs where each 1009th row is missing."""
    o = source(spark, sf_dir).load("orders")
    found = verify(o, o.where(F.col("o_orderkey") % 1009 != 5), "o_orderkey")
    return spark.createDataFrame(list(found.spans), "first_key long, last_key long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"copy_{t}": functools.partial(copied, table=t) for t in KEYS}
    found |= {f"pk_range_{t}": functools.partial(key_range_of, table=t) for t, k in KEYS.items() if k}
    found |= {f"columns_{t}": functools.partial(columns_of, table=t) for t in ("orders", "documents", "embeddings")}
    return found | {
        "copy_warehouse_nation": copy_to_warehouse, "copy_resumed_orders": copy_resumed, "copy_replayed_labels": copy_replayed, "copy_unkeyed_twice_lineitem": copy_unkeyed_twice,
        "pk_range_empty": key_range_empty, "row_count_all": row_counts, "discover_tables": discovered, "chunk_scan_labels": chunk_scan,
        "chunk_ledger_labels": chunk_ledger, "batch_ledger_labels": batch_ledger, "composite_chunk_conversations": composite_chunk,
        "resume_remaining_orders": resume_remaining, "progress_after_sync": progress_after_sync, "sync_summary": sync_summary, "reconcile_all": reconciled,
        "failure_isolation": failure_isolated, "failure_summary": failure_summary, "sync_restarted": restarted, "progress_rates_labels": progress_rates,
        "sorted_copy_labels": sorted_copy, "copied_keys": copied_keys, "repeated_keys_all": repeats, "files_after_resume": resumed_files,
        "verify_all": verified, "verify_damaged": verified_damaged, "verify_damaged_parts": damaged_parts,
    }


def _progress_sql(t: str) -> str:
    k = KEYS[t]
    return f"SELECT '{t}' AS table_name, count(*) AS total_rows, count(*) AS synced_rows, '{k}' AS primary_key, CAST(max({k}) AS BIGINT) AS last_pk_value, 'done' AS status FROM {t}"


def oracle_sql() -> dict[str, str]:
    union = " UNION ALL ".join
    found = {f"copy_{t}": f"SELECT * FROM {t}" for t in KEYS}
    found |= {f"pk_range_{t}": f"SELECT CAST(coalesce(min({k}), 0) AS BIGINT) AS min_pk, CAST(coalesce(max({k}), 0) AS BIGINT) AS max_pk FROM {t}" for t, k in KEYS.items() if k}
    found |= {f"columns_{t}": f"SELECT column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name = '{t}'" for t in ("orders", "documents", "embeddings")}
    total = " + ".join(f"(SELECT count(*) FROM {t})" for t in SYNCED)
    new = " + ".join(f"(SELECT count(*) FROM {t})" for t in SYNCED[2:])
    return found | {
        "copy_warehouse_nation": "SELECT * FROM nation",
        "copy_resumed_orders": "SELECT * FROM orders",
        "copy_replayed_labels": "SELECT * FROM labels",
        "copy_unkeyed_twice_lineitem": "SELECT * FROM lineitem",
        "pk_range_empty": "SELECT CAST(coalesce(min(o_orderkey), 0) AS BIGINT) AS min_pk, CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS max_pk FROM orders WHERE o_orderkey < 0",
        "row_count_all": union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in KEYS),
        "discover_tables": f"SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in KEYS)}) AS v(table_name)",
        "chunk_scan_labels": "SELECT * FROM labels",
        "chunk_ledger_labels": """
WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM labels),
c AS (SELECT i AS chunk_id, lo + i * 100 AS chunk_start, least(lo + i * 100 + 99, hi) AS chunk_end FROM b, LATERAL (SELECT unnest(generate_series(0, (hi - lo) // 100)) AS i))
SELECT chunk_id, chunk_start, chunk_end, count(doc_id) AS chunk_rows, CAST(sum(count(doc_id)) OVER (ORDER BY chunk_id) AS BIGINT) AS synced_rows
FROM c LEFT JOIN labels ON doc_id BETWEEN chunk_start AND chunk_end GROUP BY chunk_id, chunk_start, chunk_end""",
        "batch_ledger_labels": """
WITH c AS (SELECT doc_id, (doc_id - (SELECT min(doc_id) FROM labels)) // 100 AS chunk_id FROM labels),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch_id FROM c)
SELECT chunk_id, batch_id, min(doc_id) AS first_pk, max(doc_id) AS last_pk, count(*) AS batch_rows FROM n GROUP BY chunk_id, batch_id""",
        "composite_chunk_conversations": "SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
        "resume_remaining_orders": "SELECT * FROM orders WHERE o_orderkey >= 8000",
        "progress_after_sync": union(_progress_sql(t) for t in SYNCED),
        "sync_summary": f"SELECT CAST({len(SYNCED)} AS BIGINT) AS tables, CAST({total} AS BIGINT) AS total_rows, CAST({new} AS BIGINT) AS copied_rows, CAST(2 AS BIGINT) AS skipped_tables, CAST(0 AS BIGINT) AS failed_tables",
        "failure_isolation": "SELECT 'region' AS table_name, 'done' AS status, count(*) AS synced_rows, false AS has_error FROM region UNION ALL SELECT 'nation', 'done', count(*), false FROM nation UNION ALL SELECT 'no_such_table', 'failed', 0, true",
        "failure_summary": "SELECT CAST(3 AS BIGINT) AS tables, n AS total_rows, n AS copied_rows, CAST(0 AS BIGINT) AS skipped_tables, CAST(1 AS BIGINT) AS failed_tables FROM (SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS BIGINT) AS n)",
        "sync_restarted": f"SELECT CAST({len(SYNCED)} AS BIGINT) AS tables, CAST({total} AS BIGINT) AS total_rows, CAST({total} AS BIGINT) AS copied_rows, CAST(0 AS BIGINT) AS skipped_tables, CAST(0 AS BIGINT) AS failed_tables",
        "progress_rates_labels": """
WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n FROM labels),
c AS (SELECT i AS chunk_id, least(lo + i * 100 + 99, hi) AS chunk_end, n FROM b, LATERAL (SELECT unnest(generate_series(0, (hi - lo) // 100)) AS i)),
s AS (SELECT chunk_id, n, count(doc_id) AS synced FROM c LEFT JOIN labels ON doc_id <= chunk_end GROUP BY chunk_id, n)
SELECT chunk_id, CAST(synced AS DOUBLE) / n * 100 AS percent, CASE WHEN chunk_id > 0 THEN CAST(synced AS DOUBLE) / (chunk_id * CAST(0.25 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS rows_per_second, CAST(0 AS DOUBLE) AS of_nothing FROM s""",
        "sorted_copy_labels": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS late_rows FROM labels",
        "copied_keys": union(f"SELECT '{t}' AS table_name, {f"'{KEYS[t]}'" if KEYS[t] else 'CAST(NULL AS VARCHAR)'} AS primary_key" for t in (*SYNCED, "lineitem")),
        "repeated_keys_all": union(f"SELECT '{t}' AS table_name, '{k}' AS key_column, count({k}) - count(DISTINCT {k}) AS repeated_rows FROM {t}" for t, k in (KEYS | {"lineitem": "l_orderkey"}).items()),
        "files_after_resume": "SELECT 'orders' AS table_name, CAST(8 AS BIGINT) AS files, count(*) AS rows, CAST(max(o_orderkey) AS BIGINT) AS high FROM orders",
        "verify_all": union(f"SELECT '{t}' AS table_name, CAST(0 AS BIGINT) AS differing_parts, count(*) AS source_rows, count(*) AS target_rows, CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows FROM {t}" for t in KEYS),
        "verify_damaged": """
SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) - count(*) FILTER (o_orderkey % 1009 = 5) + count(*) FILTER (o_orderkey % 1009 = 9) AS target_rows,
       count(*) FILTER (o_orderkey % 1009 IN (5, 7)) AS missing_rows, count(*) FILTER (o_orderkey % 1009 IN (7, 9)) AS extra_rows FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*) + count(*) FILTER (l_orderkey % 997 = 3), 0, count(*) FILTER (l_orderkey % 997 = 3) FROM lineitem""",
        "verify_damaged_parts": """
WITH b AS (SELECT min(o_orderkey) AS low, max(o_orderkey) - min(o_orderkey) AS span FROM orders),
w AS (SELECT low, CAST(1 AS BIGINT) << CAST(greatest(0, length(ltrim(bin(span), '0')) - 12) AS BIGINT) AS width FROM b)
SELECT DISTINCT CAST(low + (o_orderkey - low) // width * width AS BIGINT) AS first_key, CAST(low + (o_orderkey - low) // width * width + width - 1 AS BIGINT) AS last_key
FROM orders, w WHERE o_orderkey % 1009 = 5""",
        "reconcile_all": union(f"SELECT '{t}' AS table_name, count(*) AS source_rows, count(*) AS target_rows, CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows FROM {t}" for t in (*SYNCED, "lineitem")),
    }
