"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.store import drop, keep


def _flat(edges: DataFrame) -> bool:
    """Whether ``edges`` (a, b) are stars: no centre hangs on another, and nothing hangs twice."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("hangs")).union(edges.select("b", F.lit(0)).distinct())
    return ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least")).filter("n > 1 OR n = 1 AND least = 0").isEmpty()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, each node's larger (or smaller) neighbours hung on its least neighbour."""
    near = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges
    near = near.toDF("node", "next")
    least = near.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("m"))
    hung = near.join(least, "node")
    kept = hung.filter("next > node") if large else hung
    out = kept.select(F.col("next").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the least id reachable, for each id that ``links`` (two columns of one type) names; a kept table.

    Each round at least halves the depth of what isn't a star yet; a round reads what the last wrote.
    """
    a, b = links.columns
    found = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = keep(found, "edges")
    while not _flat(edges):
        after = keep(_stars(_stars(edges, large=True), large=False), "edges")
        drop(edges)
        edges = after
    roots = edges.select("b").distinct()
    out = keep(edges.toDF("id", "component").union(roots.select(F.col("b").alias("id"), F.col("b").alias("component"))), "components")
    drop(edges)
    return out
