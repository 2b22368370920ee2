"""Connected components as DataFrame rounds: every node joins its smallest neighbour, chains are
shortened by pointer jumping, edges are contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``: the smallest node reachable, for every node of an edge.

    A round at least halves the nodes that still have edges, so there are O(log n) rounds; each is made of
    aggregations with map-side combine and equi-joins, so a node with very many edges is no bottleneck.
    Loops and rows with a null end are no edges; repeated and reversed edges count once. No edges: no rows.
    """
    live = stage(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not live.isEmpty():
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(live.select("v", "u"))
        parents = stage(both.groupBy("node").agg(F.min("other").alias("low"))
                        .select("node", F.least("node", "low").alias("parent")), "parents")
        moving = True
        while moving:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            parents = stage(parents.join(up, "parent").select(
                "node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "parents")
            moving = not parents.where("moved").isEmpty()
        parents = parents.select("node", "parent")
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            roots = stage(roots.join(step, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")), "roots")
        at_u = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        at_v = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        live = stage(live.join(at_u, "u").join(at_v, "v").where("pu <> pv")
                     .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    return roots
