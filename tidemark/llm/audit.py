"""Operator 13: how five filters act together, audited by a Walsh-Hadamard transform.

Every document fails a set of the filters, a mask of five bits. For each part and class of
label 32 signed parity sums are kept: each adds a document's weight, or takes it off, by the
parity of the bits that its mask shares with the sum's number. Sums are all that is aggregated; they are
inverted exactly to the number of documents of every mask, and from these come all 120 orders of the
filters and the Shapley values in closed form: of a document that fails k filters, each of them is the
first in 120 / k orders.

Texts are read once, in expressions of the JVM. A text's mask but for its copies is a function
of the text, so rows of equal texts (by SHA-256) are added up before they are compared: a
large group of copies is a few rows of counts, and its least doc_id is found among these.
"""

from __future__ import annotations

import functools
import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import column

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASKS, ORDERS = 1 << len(FILTERS), 120
COPY = 1 << FILTERS.index("E")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def own_mask(words: Column, text: Column) -> Column:
    """The bits of A (few words), B (few distinct ones), C (many capitals) and D (junk characters)."""
    n = F.size(words)
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        F.rlike(text, F.lit(JUNK)),
    )
    return functools.reduce(lambda a, b: a + b, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)])


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: numbers of documents by part, labels and failures; equal ones may come in several rows.

    A label of an id with several is 1 if one of them is.
    """
    text = F.coalesce(column("text"), F.lit(""))
    rows = docs.select(column("doc_id").alias("doc_id"), F.coalesce(column("lang"), F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), own_mask(F.col("words"), F.col("text")).alias("mask"))
    # Rows without an id have no label; a number of their task keeps them from meeting in one.
    rows = rows.withColumn("apart", F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1)).withColumn("doc_id_", F.coalesce("doc_id", F.lit(0)))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc_id_")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("apart", F.lit(-1))
    rows = rows.join(known, ["doc_id_", "apart"], "left").na.fill(False, ["good", "toxic"])
    kind = ["key", "mask", "part", "good", "toxic"]
    each = rows.groupBy(*kind, "doc_id_", "apart").agg(F.count(F.lit(1)).alias("n"))
    known_id = F.col("apart") == -1
    of = each.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known_id, F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(known_id, F.struct("doc_id_", "n"))).alias("least"),
    )
    first = F.min("least.doc_id_").over(W.partitionBy("key"))  # over a row for each part and class of label
    copies = F.col("with_id") - F.when(F.col("least.doc_id_") == first, F.col("least.n")).otherwise(0)
    of = of.withColumn("copies", F.coalesce(copies, F.lit(0)))
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n")))
    return of.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where(F.col("n") > 0)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, good, toxic, sums: 32 signed sums of n, the transform of the numbers by mask."""
    signed = lambda w: F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(w))) % 2 == 0, F.col("n")).otherwise(-F.col("n")))
    return rows.groupBy("part", "good", "toxic").agg(F.array(*[signed(w) for w in range(MASKS)]).alias("sums"))


def inverted(sums: Column) -> Column:
    """The numbers by mask that have these sums: the transform again, by 32, which leaves no rest."""
    every, none = F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long")
    signed = lambda m, w: F.when(F.bit_count(m.bitwiseAND(w)) % 2 == 0, F.get(sums, w)).otherwise(-F.get(sums, w))
    return F.transform(every, lambda m: F.shiftright(F.aggregate(every, none, lambda a, w: a + signed(m, w)), MASKS.bit_length() - 1))


def orders() -> list[dict]:
    """Of all 120 orders the steps, each with the bits of the filters before and the bit of its own."""
    bits = lambda names: sum(1 << FILTERS.index(f) for f in names)
    return [{"filter_order": "".join(o), "step": k + 1, "before": bits(o[:k]), "bit": bits(o[k])} for o in itertools.permutations(FILTERS) for k in range(len(o))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    A null text is empty, a null language the part of that name. A copy is a document whose text equals that of a document with a
    smaller doc_id, wherever it is and whether or not it stays; rows without a doc_id are no copies, nor do they make any, and rows
    of one id aren't copies of each other. Repeated rows count one by one. Texts of any length are read whole. Parts without documents have no
    rows, an empty table none at all. Other columns, whatever their names, don't matter.
    """
    sums = parity_sums(masked(docs, labels))
    cells = sums.select("part", "good", "toxic", inverted(F.col("sums")).alias("cells"))
    picked = lambda c, which: F.sum(F.when(which, c).otherwise(0))
    by_part = cells.groupBy("part").agg(*[
        F.array(*[picked(F.col("cells")[m], which) for m in range(MASKS)]).alias(name)
        for name, which in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))
    ])

    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, before int, bit int>>")
    rows = by_part.select("*", F.explode(steps).alias("s")).select("*", "s.*")
    before, bit = F.col("before"), F.col("bit")

    def total(name: str, which) -> Column:
        """The numbers of the masks that `which` picks."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(which(m), F.get(F.col(name), m)).otherwise(0))

    meets = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: meets(m, bit) & ~meets(m, before)
    share = F.aggregate(F.sequence(F.lit(1), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(meets(m, bit), F.get(F.col("all"), m) * (ORDERS / F.bit_count(m)).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~meets(m, before.bitwiseOR(bit))).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: meets(m, bit) & meets(m, before)).alias("redundant"),
        total("all", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    """Every document against every order, without sums."""
    order = ", ".join(f"('{''.join(o)}')" for o in itertools.permutations(FILTERS))
    return f"""
WITH known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END) AS f
  FROM cut LEFT JOIN known USING (doc_id)
), cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM failing GROUP BY part, f),
steps AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS x, left(o, k - 1) AS before FROM (VALUES {order}) v(o), range(1, 6) r(k)),
placed AS (SELECT *, contains(f, x) AS fails, CASE WHEN step > 1 THEN regexp_matches(f, '[' || before || ']') ELSE false END AS gone FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, x, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
         sum(n) FILTER (f = x) AS unique_fails, sum(g) FILTER (fails AND NOT gone) AS good_lost, sum(t) FILTER (fails AND NOT gone) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted"""


OP13_SQL = _sql()
