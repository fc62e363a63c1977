"""The folder that all executors and the driver share, and rows that carry columns of any name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder is set for the session, but on a single machine only."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder, without its lineage: lost executors don't lose it."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, of few and narrow columns, written as Parquet to the shared folder and read from there.

    As safe from lost executors as `settled`; but small files are read together by few tasks, and
    the planner knows their size. Names must differ in any case of letters. The files go when
    the session's JVM ends.
    """
    path = f"{scratch(df.sparkSession, f'stored-{uuid.uuid4().hex}')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(schema: StructType, more: str) -> StructType:
    """A schema with further columns, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, *apart: str) -> list[Column]:
    """All columns of docs in one struct, `_own`, where their names can't clash with others; and those apart, by themselves."""
    rest = [column(c) for c in docs.columns if c not in apart] or [F.lit(0).alias("none")]
    return [F.struct(*rest).alias("_own"), *map(column, apart)]


def restored(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of docs, in order: from `new` if named there, else out of `_own`."""
    return [new[c].alias(c) if c in new else F.col("_own").getField(c).alias(c) for c in docs.columns]
