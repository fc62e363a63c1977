"""Reports on plans and runs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quoted, rate
from ..model import SyncResult
from ..plans import chunk_frame, chunk_of
from .scan import key_range

logger = logging.getLogger(__name__)
#: Chunks whose running total one task works out.
STRETCH = 10_000


def chunk_report(rows: DataFrame, key: str, size: int) -> DataFrame:
    """chunk_id, chunk_start, chunk_end, chunk_rows, synced_rows (running total) of every chunk, empty ones included.

    Rows are counted by chunk before anything is ordered; the running total orders chunks within
    stretches of so many, and then the stretches' sums.
    """
    span = key_range(rows, key)
    if not span.rows:
        return rows.sparkSession.createDataFrame([], "chunk_id long, chunk_start long, chunk_end long, chunk_rows long, synced_rows long")
    counts = rows.groupBy(chunk_of(F.col(quoted(key)), span.low, size).cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    plan = chunk_frame(rows.sparkSession, span.low, span.high, size).join(counts, "chunk_id", "left")
    plan = plan.select("chunk_id", "chunk_start", "chunk_end", F.coalesce("n", F.lit(0)).alias("chunk_rows"), F.floor(F.col("chunk_id") / STRETCH).alias("stretch"))
    sums = plan.groupBy("stretch").agg(F.sum("chunk_rows").alias("n"))
    before = sums.select("stretch", (F.sum("n").over(W.orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.sum("chunk_rows").over(W.partitionBy("stretch").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, 0))
    return plan.withColumn("own", own).join(before, "stretch").select("chunk_id", "chunk_start", "chunk_end", "chunk_rows", (F.col("before") + F.col("own")).alias("synced_rows"))


def batch_report(rows: DataFrame, key: str, size: int, batch: int) -> DataFrame:
    """chunk_id, batch_id, first_pk, last_pk, batch_rows: a chunk's rows by key, cut after every `batch` rows.

    Rows are counted by key first, so a chunk is ordered as at most `size` counts, however many rows a key has.
    """
    low = key_range(rows, key).low
    k = F.col(quoted(key))
    counted = rows.select(k.alias("k"), chunk_of(k, low, size).cast("long").alias("chunk_id")).groupBy("chunk_id", "k").agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(W.partitionBy("chunk_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    spans = counted.select("chunk_id", "k", until.alias("until"), (until - F.col("n")).alias("since"))
    number = lambda at: (at - at % batch) / batch  # noqa: E731  at is whole, and so is this
    cut = spans.withColumn("batch_id", F.explode(F.sequence(number(F.col("since")).cast("long"), number(F.col("until") - 1).cast("long"))))
    own = F.least("until", (F.col("batch_id") + 1) * batch) - F.greatest("since", F.col("batch_id") * batch)
    return cut.groupBy("chunk_id", "batch_id").agg(F.min("k").alias("first_pk"), F.max("k").alias("last_pk"), F.sum(own).alias("batch_rows"))


SUMMARY = "table_name string, rows long, copied long, seconds double, skipped boolean, error string"


def results_frame(spark: SparkSession, results: list[SyncResult]) -> DataFrame:
    rows = [(r.table, r.rows, r.copied, float(r.time), r.skipped, r.error) for r in results]
    return spark.createDataFrame(rows, SUMMARY).withColumn("rows_per_second", rate(F.col("rows"), F.col("seconds")))


def summary(spark: SparkSession, results: list[SyncResult]) -> DataFrame:
    """One row: tables, total_rows, copied_rows, skipped_tables, failed_tables."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return results_frame(spark, results).agg(
        F.count(F.lit(1)).alias("tables"), n(F.sum("rows")).alias("total_rows"), n(F.sum("copied")).alias("copied_rows"),
        n(F.count_if("skipped")).alias("skipped_tables"), n(F.count_if(F.col("error").isNotNull())).alias("failed_tables"),
    )


def log_summary(results: list[SyncResult], seconds: float) -> None:
    rows = sum(r.rows for r in results)
    logger.info("done: %d rows of %d tables in %.1f s (%.0f rows/s); %d tables were complete already", rows, len(results), seconds, rows / seconds if seconds > 0 else 0, sum(r.skipped for r in results))
    if failed := [r.table for r in results if r.error is not None]:
        logger.error("failed: %s", ", ".join(failed))
    for r in results:
        logger.info("%-40s %12d rows %9.1f s  %s", r.table, r.rows, r.time, f"error: {r.error}" if r.error is not None else "complete already" if r.skipped else "ok")
