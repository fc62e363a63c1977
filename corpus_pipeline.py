"""A corpus pipeline over documents; each stage is one operator of tidemark.llm.

Documents that the quality rules reject go; of each class of near duplicates one document
stays; passages that occur anywhere else are cut; personal data get pseudonyms; what is left
is packed into sequences of token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, pii, quality, shared, substrings

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", quality.keep_good),
    ("near_duplicates", jaccard.drop_near),
    ("substring_dedup", substrings.cut_documents),
    ("pii", pii.pseudonymise_documents),
    ("packing", packing.pack_documents),
]

#: SQL can't express the classifier, the hashes or the packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written to the shared folder and read again by the next; that folder goes when the session's JVM ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.scratch(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
