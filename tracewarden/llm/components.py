"""Connected components by alternating large-star and small-star rounds (DataFrame joins, no driver state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another; root is the smallest node it can reach, itself included.

    Every round aggregates before it shuffles; it ends when no edge changes, in a logarithmic number of rounds.
    """
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = _print(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
