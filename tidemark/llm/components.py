"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _least(links: DataFrame) -> DataFrame:
    """Each node's least neighbour, kept: a join with it then reads both sides from plain exchanges, whose large partitions Spark splits, as those of a hub."""
    return stored(links.groupBy("a").agg(F.min("b").alias("m")))


def _are_stars(links: DataFrame) -> bool:
    """Does every node either hang below one other, or have others below it?"""
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end")
    nodes = links.select(ends).groupBy("end.x").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component.

    Each round hangs every node's larger neighbours below its least one, then does so with
    the smaller ones, until the links are stars. The links are cut off from their lineage
    by written tables in the shared folder; the driver only learns whether they are stars.
    Nodes without links don't appear; null ends are left out.
    """
    clean = lambda x: x.where(F.col("a") != F.col("b")).distinct()
    now = stored(clean(links.select("a", "b").dropna().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        large = stored(clean(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))))
        ends = F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")
        now = stored(clean(large.join(_least(large), "a").select(ends).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))))
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
