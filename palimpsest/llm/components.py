"""Connected components by alternating large and small stars, as joins on partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node's neighbours and itself; map-side minima, so a node of any degree is one row a task."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of an edge (u, v) the least id that it is linked with, its own included. Runs until nothing changes."""
    at = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = _both(at)
        # large star: greater neighbours are hung on the least
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        # small star: lesser neighbours, and the node itself, are hung on the least
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, at = at, materialize(small.filter("u <> v").distinct(), "small")
        discard(before, large)
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
