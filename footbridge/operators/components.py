"""Connected components of the walk graph, as a table that is built once and asked often.

Two platforms whose vertices share no component have no walk, so nothing has to be searched for them. A component is
blind to directions, so vertices that share one may still have no walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge.functions import tags as tg
from footbridge.operators.graph import node_ways
from footbridge.session import count_true, materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges`` (``a, b``); a component has the number of its least node.

    Star contraction: each round every node's greater neighbours move to its least neighbour, then its lesser ones do.
    Paths shrink to stars in a number of rounds that grows with the logarithm of their length; a round is written, so it
    survives lost executors. Minima are taken before the shuffle, and a hub's edges may be split by a skewed join.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    stars, seen = materialise(start, n=F.count(F.lit(1)))
    while seen["n"]:
        both = stars.unionByName(stars.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root"))
        large = both.where("b > a").join(least, "a").selectExpr("b as a", "root as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a")
        small = small.selectExpr("b as a", "root as b").unionByName(small.selectExpr("a", "root as b")).where("a <> b").distinct()
        before = seen["n"]
        known = stars.withColumn("known", F.lit(True))
        stars, seen = materialise(small.join(known, ["a", "b"], "left"), n=F.count(F.lit(1)), new=count_true(F.col("known").isNull()))
        stars = stars.select("a", "b")
        if not seen["new"] and seen["n"] == before:
            break
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def walk_components(ways: DataFrame) -> DataFrame:
    """``node_id, component`` of the vertices of walkable ways. Floors of one node belong together."""
    on = node_ways(ways.where(tg.is_walkable("tags"))).select("way_id", "node_id")
    first = on.groupBy("way_id").agg(F.min("node_id").alias("first"))
    return components(on.join(first, "way_id").selectExpr("first as a", "node_id as b")).withColumnRenamed("node", "node_id")


def stitched_components(own: DataFrame, bridges: DataFrame) -> DataFrame:
    """``component, stitched``: the components that stitch bridges join, among components only."""
    of = own.select("node_id", "component")
    ends = bridges.select("node_a", "node_b").join(of.selectExpr("node_id as node_a", "component as a"), "node_a").join(
        of.selectExpr("node_id as node_b", "component as b"), "node_b")
    joined = components(ends.select("a", "b")).selectExpr("node as component", "component as joined")
    return own.select("component").distinct().join(joined, "component", "left").select(
        "component", F.coalesce("joined", "component").alias("stitched"))


def reachable_pairs(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The ``pairs`` (``relation_id, from_ref, to_ref``) whose ends share a stitched component, with ``near``: whether
    they share one without bridges. ``ends`` has ``relation_id, ref, component, stitched``, a row a component."""
    keys = ["relation_id", "from_ref", "to_ref"]
    at = ends.distinct()
    a = at.selectExpr("relation_id", "ref as from_ref", "component as from_part", "stitched")
    b = at.selectExpr("relation_id", "ref as to_ref", "component as to_part", "stitched")
    met = pairs.select(*keys).join(a, ["relation_id", "from_ref"]).join(b, ["relation_id", "to_ref", "stitched"])
    return met.groupBy(*keys).agg(F.bool_or(F.col("from_part") == F.col("to_part")).alias("near"))
