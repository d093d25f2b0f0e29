"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregation and a join on edges; no component is ever gathered in one task, and
nothing but two numbers per round reaches the driver. Each round's edges are written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id reachable. Edges may repeat; loops count for nothing."""
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialize(now, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _with_least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
        new = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        discard(now)
        now = new
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
