"""Cross-checks between platform edges, stations and way paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge.functions.geo import haversine
from footbridge.operators.graph import node_ways, walkable_closure, way_points


def opposite_platforms(pairs: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of edges joined by one way holding nodes of both, and the gap between the edges.

    ``pairs`` has ``relation_id, way_a, way_b``; the pair's own ways do not count as the joint.
    """
    touch = node_ways(ways)

    def linked(side: str) -> DataFrame:
        mine = pairs.select(F.col(side).alias("way_id")).distinct().join(touch, "way_id").select(F.col("way_id").alias(side), "node_id")
        return mine.join(touch.withColumnRenamed("way_id", "via"), "node_id").where(F.col("via") != F.col(side)).select(side, "via").distinct()

    joint = pairs.join(linked("way_a"), "way_a").join(linked("way_b"), ["way_b", "via"]).groupBy("way_a", "way_b").agg(
        F.min("via").alias("connecting_way"))
    at = way_points(ways, nodes).select("way_id", "lat", "lon")
    gap = joint.join(at.selectExpr("way_id as way_a", "lat as a_lat", "lon as a_lon"), "way_a").join(
        at.selectExpr("way_id as way_b", "lat as b_lat", "lon as b_lon"), "way_b").groupBy("way_a", "way_b", "connecting_way").agg(
        F.min(haversine("a_lat", "a_lon", "b_lat", "b_lon")).alias("gap_m"))
    return gap


def edge_stations(edges: DataFrame, station_ways: DataFrame, ways: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Platform edges to the station whose platform ways share a node with them.

    Edges sharing none are grown through walkable ways until nothing new is reached, or for ``max_rounds`` rounds. Several
    stations: the one sharing most nodes, then the lowest id. Returns ``way_id, relation_id, rounds, shared``.
    """
    own = station_ways.join(node_ways(ways), "way_id").select("relation_id", "node_id").distinct()
    edge_nodes = node_ways(edges)

    def pick(hits: DataFrame) -> DataFrame:
        counts = hits.groupBy("way_id", "relation_id", "rounds").agg(F.count_distinct("node_id").alias("shared"))
        best = F.struct("rounds", (-F.col("shared")).alias("s"), "relation_id")
        return counts.groupBy("way_id").agg(F.min_by(F.struct("relation_id", "rounds", "shared"), best).alias("b")).select("way_id", "b.*")

    direct = pick(edge_nodes.join(own, "node_id").withColumn("rounds", F.lit(0)))
    misses = edge_nodes.join(direct.select("way_id"), "way_id", "left_anti")
    empty_nodes = ways.sparkSession.createDataFrame([], "id long, lat double, lon double")
    grown = walkable_closure(
        misses.select(F.col("way_id").alias("relation_id"), "node_id"), ways, empty_nodes, None, max_rounds)
    reached = grown.select(F.col("relation_id").alias("edge"), "way_id", F.col("round").alias("rounds")).join(
        node_ways(ways), "way_id").select(F.col("edge").alias("way_id"), "node_id", "rounds")
    later = pick(reached.join(own, "node_id"))
    return direct.unionByName(later)


def path_polyline(path_ways: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The points of a way path in walking order (``path_id, seq, lat, lon``).

    A way is reversed when only its last node lies on the way before it; a joint is not repeated.
    """
    lists = path_ways.join(ways.select(F.col("id").alias("way_id"), "nodes"), "way_id")
    order = Window.partitionBy("path_id").orderBy("ord")
    before = lists.withColumn("prev", F.lag("nodes").over(order))
    first, last = F.element_at("nodes", 1), F.element_at("nodes", -1)
    flip = F.col("prev").isNotNull() & F.array_contains("prev", last) & ~F.array_contains("prev", first)
    steps = before.select("path_id", "ord", F.posexplode(F.when(flip, F.reverse("nodes")).otherwise(F.col("nodes"))).alias("k", "node_id"))
    located = steps.join(nodes.where("lat is not null").select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    walk = Window.partitionBy("path_id").orderBy("ord", "k")
    joint = (F.col("k") == 0) & F.coalesce(
        (F.lag("lat").over(walk) == F.col("lat")) & (F.lag("lon").over(walk) == F.col("lon")), F.lit(False))
    kept = located.withColumn("joint", joint).where("not joint")
    return kept.select("path_id", (F.row_number().over(walk) - 1).alias("seq"), "node_id", "lat", "lon")
