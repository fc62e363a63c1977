"""Following a growing folder of Parquet files: an addition to table copies, which take a table as it is.

For sources that only ever gain files. Spark's checkpoint remembers the files taken, so a
run copies what is new since the last one, each file exactly once. Keys and chunks play no part.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def follow_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType | None = None, files_per_batch: int = 1000) -> int:
    """Copy the files of `source` that earlier runs haven't taken into the folder `target`; how many rows that was."""
    schema = schema or spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
