"""From map tables to resolved platforms and walks, for all stations at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.operators import components, graph, journeys, platforms, spatial, walks, ways as way_ops
from footbridge.session import count_true, cut, materialise


@dataclass
class Stations:
    """Derived tables of a map, each built once and shared by the plans below."""

    nodes: DataFrame
    ways: DataFrame
    members: DataFrame
    relations: DataFrame

    @cached_property
    def closure(self) -> DataFrame:
        return cut(graph.relation_closure(self.members))

    @cached_property
    def station_closure(self) -> DataFrame:
        stations = self.relations.where(
            tg.tag("tags", "public_transport").isin("stop_area", "stop_area_group")
        ).select(F.col("id").alias("relation_id"))
        return self.closure.join(stations, "relation_id", "left_semi")

    @cached_property
    def platform_points(self) -> DataFrame:
        return graph.way_points(self.ways.where(tg.is_any_platform("tags")), self.nodes)

    @cached_property
    def boxes(self) -> DataFrame:
        """Routing boxes: seeded from walkable members only."""
        return cut(graph.station_boxes(self.station_closure, self.nodes, self.ways))

    @cached_property
    def footprint(self) -> DataFrame:
        return cut(graph.station_footprint(self.boxes, self.platform_points))

    @cached_property
    def list_footprint(self) -> DataFrame:
        """The platform list seeds its box from all member ways, station outlines included."""
        boxes = graph.station_boxes(self.station_closure, self.nodes, self.ways, only_walkable=False)
        return graph.station_footprint(boxes, self.platform_points)

    @cached_property
    def refs(self) -> DataFrame:
        return platforms.platform_refs(self.list_footprint, self.ways)

    @cached_property
    def centres(self) -> DataFrame:
        return cut(platforms.station_points(self.station_closure, self.relations, self.nodes, self.ways))

    @cached_property
    def stops(self) -> DataFrame:
        return way_ops.station_stops(self.nodes)

    @cached_property
    def bridges(self) -> DataFrame:
        return cut(platforms.stitch_bridges(self.ways, self.nodes))


    @cached_property
    def parts(self) -> DataFrame:
        """The component of every walkable vertex, without bridges and with them."""
        own = cut(components.walk_components(self.ways))
        return cut(own.join(cut(components.stitched_components(own, self.bridges)), "component"))


def resolve_ends(st: Stations, ends: DataFrame, recover: bool = True) -> tuple[DataFrame, DataFrame]:
    """Platform ends to graph vertices over all tiers.

    ``ends`` has ``end_id, relation_id, ref`` and optionally ``lat, lon`` (the caller's own
    coordinate, used only when nothing on the map carries the ref). Returns the mapping
    ``end_id, place`` and the vertices ``place, way_id, node_id, by_coord``. Ends that come down
    to the same vertices share a place, so a search from it runs once; unresolved ends have none.
    """
    if "lat" not in ends.columns:
        ends = ends.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")})
    ends = ends.select("end_id", "relation_id", "ref", "lat", "lon").distinct()
    asked = ends.select("relation_id", "ref").distinct()
    by_tag = platforms.resolve_platforms(asked, st.footprint, st.ways)
    misses = asked.join(by_tag.select("relation_id", "ref").distinct(), ["relation_id", "ref"], "left_anti")
    by_stop = platforms.resolve_by_stop(misses, st.boxes, st.stops, st.ways, st.nodes)
    tagged = cut(platforms.way_anchors(by_tag, st.platform_points).unionByName(
        by_stop.select("relation_id", "ref", "way_id", F.col("anchor").alias("node_id"))))
    place = F.concat_ws("|", "relation_id", "ref").alias("place")
    known = tagged.select("relation_id", "ref", place).distinct()
    placed = ends.join(known, ["relation_id", "ref"], "left")
    spot = F.concat_ws("@", F.lit(""), "anchor", "way_id").alias("place")
    snapped = cut(platforms.resolve_by_coord(placed.where("place is null").drop("place"), st.ways, st.nodes))
    mapping = placed.where("place is not null").select("end_id", "place").unionByName(
        snapped.select("end_id", spot))
    vertices = tagged.select(place, "way_id", "node_id", F.lit(False).alias("by_coord")).unionByName(
        snapped.select(spot, "way_id", F.col("anchor").alias("node_id"), "by_coord").distinct())
    if not recover:
        return mapping, vertices
    own = cut(vertices).withColumnRenamed("place", "platform")
    ways_of = own.select("platform", "way_id").distinct()
    lonely = cut(platforms.isolated_platforms(ways_of, st.ways))
    saved = cut(platforms.recover_isolated(lonely, ways_of, st.ways, st.nodes, own)).select(
        F.col("platform").alias("place"), "way_id", F.col("anchor").alias("node_id"), F.lit(True).alias("by_coord"))
    own = own.withColumnRenamed("platform", "place")
    return mapping, own.join(saved.select("place").distinct(), "place", "left_anti").unionByName(saved)


def graph_edges(
    st: Stations, anchors: DataFrame, step_free: bool = False, stitched: bool = False, contract: bool = True,
) -> DataFrame:
    """The edge table of a routing profile, written once and reused by every round."""
    bridges = st.bridges if stitched else None
    keep = anchors.select("node_id")
    if bridges is not None:
        keep = keep.unionByName(bridges.select(F.col("node_a").alias("node_id"))).unionByName(
            bridges.select(F.col("node_b").alias("node_id")))
    edges = graph.walk_edges(st.ways, st.nodes, keep, contract)
    return cut(graph.apply_profile(edges, step_free, bridges))


def end_key(relation: str, ref: str, lat: str | None = None, lon: str | None = None):
    """A stable text key of one platform end."""
    parts = [F.col(relation).cast("string"), F.col(ref)]
    if lat is not None:
        parts += [F.coalesce(F.round(lat, 6).cast("string"), F.lit("")), F.coalesce(F.round(lon, 6).cast("string"), F.lit(""))]
    return F.concat_ws("|", *parts)


def pair_ends(pairs: DataFrame) -> DataFrame:
    """The ends of ``pairs`` (``relation_id, from_ref, to_ref``) as ``walk_between`` names them."""
    ends = pairs.selectExpr("relation_id", "from_ref as ref").unionByName(pairs.selectExpr("relation_id", "to_ref as ref")).distinct()
    ends = ends.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")})
    return ends.withColumn("end_id", end_key("relation_id", "ref", "lat", "lon"))


def walk_between(
    st: Stations, requests: DataFrame, step_free: bool = False, stitched: bool = False,
    with_path: bool = False, recover: bool = True, contract: bool = True,
    resolved: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Walks for ``request_id, relation_id, from_ref, to_ref`` and optional end coordinates.

    Optional columns ``from_lat, from_lon, to_lat, to_lon`` feed the coordinate tier. Returns
    one row per request: ``found, seconds, metres, reason, source_by_coord, target_by_coord``.
    ``resolved`` is what ``resolve_ends`` gave for the requests' ends, where the caller has it.
    """
    coords = "from_lat" in requests.columns
    if not coords:
        requests_in = requests.withColumns({c: F.lit(None).cast("double") for c in ("from_lat", "from_lon", "to_lat", "to_lon")})
    else:
        requests_in = requests
    keyed = cut(requests_in.withColumn("from_end", end_key("relation_id", "from_ref", "from_lat", "from_lon")).withColumn(
        "to_end", end_key("relation_id", "to_ref", "to_lat", "to_lon")))
    ends = keyed.selectExpr("from_end as end_id", "relation_id", "from_ref as ref", "from_lat as lat", "from_lon as lon").unionByName(
        keyed.selectExpr("to_end as end_id", "relation_id", "to_ref as ref", "to_lat as lat", "to_lon as lon"))
    mapping, anchors = resolved or resolve_ends(st, ends, recover)
    anchors = cut(anchors) if resolved is None else anchors
    edges = graph_edges(st, anchors, step_free, stitched, contract)
    flags = anchors.groupBy("place").agg(F.bool_or("by_coord").alias("by_coord"))
    placed = cut(mapping.join(flags, "place"))
    both = keyed.join(placed.selectExpr("end_id as from_end", "place as start_key", "by_coord as source_by_coord"), "from_end", "left").join(
        placed.selectExpr("end_id as to_end", "place as goal_key", "by_coord as target_by_coord"), "to_end", "left")
    both = cut(both)
    ready = both.where("source_by_coord is not null and target_by_coord is not null")
    # the straight line depends on the pair of ends, not on the request
    pairs = ready.select("start_key", "goal_key").distinct().withColumn(
        "request_id", F.concat_ws(">", "start_key", "goal_key"))
    cutoffs = walks.walk_cutoff(
        pairs.join(anchors.select(F.col("place").alias("start_key"), "node_id"), "start_key"),
        pairs.join(anchors.select(F.col("place").alias("goal_key"), "node_id"), "goal_key"), st.nodes)
    asked = cut(pairs.join(cutoffs, "request_id").select("request_id", "start_key", "goal_key", "cutoff_s"))
    from_at = anchors.select(F.col("place").alias("start_key"), "node_id")
    goal_at = anchors.select(F.col("place").alias("goal_key"), "node_id")
    found = walks.shortest_walks(asked, from_at, goal_at, edges, with_path, nodes=st.nodes).join(
        asked.select("request_id", "cutoff_s"), "request_id")
    doubt = (F.col("reason") == M.DISCONNECTED) & (F.col("reach_s") > F.col("cutoff_s"))
    found, seen = materialise(found, doubt=count_true(doubt))
    if contract and seen["doubt"]:
        again = asked.join(found.where(doubt).select("request_id"), "request_id", "left_semi")
        plain = graph_edges(st, anchors, step_free, stitched, contract=False)
        redone = walks.shortest_walks(again, from_at, goal_at, plain, with_path, nodes=st.nodes).join(
            asked.select("request_id", "cutoff_s"), "request_id")
        found = found.where(~F.coalesce(doubt, F.lit(False))).unionByName(redone)
    found = found.drop("cutoff_s", "reach_s")
    by_pair = found.join(asked.select("request_id", "start_key", "goal_key"), "request_id").drop("request_id")
    return both.join(by_pair, ["start_key", "goal_key"], "left").select(
        *requests.columns,
        F.coalesce("found", F.lit(False)).alias("found"), "seconds", "metres", "reached_node",
        *(["path"] if with_path else []),
        *(["start_key", "goal_key"] if with_path else []),
        F.when(F.col("source_by_coord").isNull() | F.col("target_by_coord").isNull(), F.lit(M.PLATFORM_NOT_FOUND))
        .otherwise(F.col("reason")).alias("reason"),
        F.coalesce("source_by_coord", F.lit(False)).alias("source_by_coord"),
        F.coalesce("target_by_coord", F.lit(False)).alias("target_by_coord"))


def assess_changes(st: Stations, changes: DataFrame, step_free: bool = False, stitched: bool = False) -> tuple[DataFrame, DataFrame]:
    """Changes of train to walks and verdicts: (keyed changes with times, one walk per key).

    Guards run before any spatial work; the walk of a change shared by journeys is found once.
    """
    keyed, unique = journeys.distinct_changes(journeys.with_times(changes))
    guarded = cut(journeys.guard(unique))
    routable = guarded.where("ruled_out is null")
    across = guarded.where(F.col("ruled_out") == M.CROSS_STATION)

    def points(df: DataFrame, *sides: str) -> DataFrame:
        parts = [df.selectExpr("change_key as query_id", f"{s}_lat as lat", f"{s}_lon as lon") for s in sides]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    near = spatial.station_candidates(points(routable, "arr", "dep"), st.centres, M.CANDIDATE_RADIUS_M, M.CANDIDATE_LIMIT)
    # a change between two stations is only named after the one it arrives at
    named = spatial.station_candidates(points(across, "arr"), st.centres, M.CANDIDATE_RADIUS_M, 1)
    candidates = cut(near.unionByName(named).withColumnRenamed("query_id", "change_key"))
    asked = routable.join(candidates.select("change_key", "relation_id"), "change_key").selectExpr(
        "change_key", "relation_id", "arr_ref as from_ref", "dep_ref as to_ref",
        "arr_lat as from_lat", "arr_lon as from_lon", "dep_lat as to_lat", "dep_lon as to_lon")
    walked = walk_between(st, asked, step_free, stitched)
    return keyed, cut(journeys.resolve_walks(guarded, candidates, walked))
