"""Connected components by alternating large-star and small-star rounds: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import removed, written


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v) with u > v."""
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars already: no node points to two others, or points and is pointed to."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (its two columns, integers): component is the smallest node reachable.

    Each round is a few hash aggregations and joins over the edges, whatever the size of a component; it is written
    to the shared folder, so a lost executor costs one round. Links of a node with itself and nulls are left out; an
    empty table gives an empty result.
    """
    a, b = links.columns[:2]
    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _settled(e):
        old = e
        e = written(_stars(old))
        removed(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
