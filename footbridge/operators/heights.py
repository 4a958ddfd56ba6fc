"""The vertical shape of a walk as tables: projection, heights, transitions, what lies along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.geo import haversine, lat_margin, lon_margin, segment_dist2
from footbridge.operators.graph import node_ways, way_points, way_segments
from footbridge.operators.spatial import in_boxes, nearest, radius_join


def plane_x(lon: Column, lon0: Column, lat0: Column) -> Column:
    return (lon - lon0) * (F.lit(M.M_PER_DEG) * F.cos(F.radians(lat0)))


def plane_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * F.lit(M.M_PER_DEG)


def origins(points: DataFrame, key: str) -> DataFrame:
    """The mean coordinate of each group of points: the origin of its local plane."""
    return points.groupBy(key).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))


def project(points: DataFrame, origin: DataFrame, key: str) -> DataFrame:
    """``lat, lon, level`` to local metres ``x, y, z`` about each group's origin."""
    return points.join(origin, key).withColumns({
        "x": plane_x(F.col("lon"), F.col("lon0"), F.col("lat0")), "y": plane_y(F.col("lat"), F.col("lat0")),
        "z": F.col("level") * M.FLOOR_HEIGHT_M}).drop("lat0", "lon0")


def extent(projected: DataFrame, key: str) -> DataFrame:
    return projected.groupBy(key).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def node_heights(ways: DataFrame, nodes: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """Height of every way vertex: sloped along a multi-level way, flat for areas at the lowest level.

    The end nodes' own single level tags orient the slope. ``origin`` (``way_id, lat0``) fixes the
    plane distances are measured in; by default each way's own mean latitude.
    """
    level = F.col("levels")
    node_level = tg.parse_levels(tg.tag("tags", "level"))
    pts = way_points(
        ways.withColumn("levels", tg.parse_levels(tg.tag("tags", "level"))), nodes,
        F.element_at(level, 1).alias("l0"), F.element_at(level, -1).alias("l1"), F.size(level).alias("floors"),
        F.array_min(level).alias("lowest"),
        (tg.is_area("tags", F.col("nodes")) & (F.size(F.array_distinct(level)) > 1)).alias("flat"),
        of_node=(F.when((F.coalesce(tg.tag("tags", "level"), F.lit("")) != "") & (F.size(node_level) == 1),
                        F.element_at(node_level, 1)).alias("own"),))
    way = Window.partitionBy("way_id")
    order = way.orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if origin is None:
        pts = pts.withColumn("lat0", F.avg("lat").over(whole))
    else:
        pts = pts.join(origin.select("way_id", "lat0"), "way_id")
    dx = (F.col("lon") - F.lag("lon").over(order)) * (F.lit(M.M_PER_DEG) * F.cos(F.radians("lat0")))
    dy = (F.col("lat") - F.lag("lat").over(order)) * F.lit(M.M_PER_DEG)
    stepped = pts.withColumn("step", F.coalesce(F.hypot(dx, dy), F.lit(0.0)))
    summed = stepped.select(
        "*", F.sum("step").over(so_far).alias("cum"), F.sum("step").over(whole).alias("total"),
        F.count(F.lit(1)).over(whole).alias("n"), F.first("own").over(whole).alias("own0"), F.last("own").over(whole).alias("own1"))
    a, b = F.coalesce("own0", "l0"), F.coalesce("own1", "l1")
    floor = (
        F.when(F.col("flat"), F.col("lowest")).when((F.col("floors") == 1) | (F.col("n") == 1), F.col("l0"))
        .otherwise(a + (b - a) * (F.col("cum") / F.when(F.col("total") == 0.0, F.lit(1.0)).otherwise(F.col("total")))))
    return summed.withColumn("z", floor * M.FLOOR_HEIGHT_M).groupBy("way_id", "node_id").agg(F.max_by("z", "pos").alias("z"))


def path_steps(paths: DataFrame) -> DataFrame:
    """``path_id, seq, node_id`` to hops ``path_id, seq, a, b``."""
    order = Window.partitionBy("path_id").orderBy("seq")
    return paths.select("path_id", "seq", F.col("node_id").alias("a"), F.lead("node_id").over(order).alias("b")).where("b is not null")


def hop_ways(steps: DataFrame, ways: DataFrame) -> DataFrame:
    """The way each hop walks: adjacent in a legal direction; a level tag, then a path tag, wins.

    Equal candidates go to the lowest way id. Hops without a way keep a null.
    """
    used = steps.select("a").distinct()
    has_level = (F.coalesce(tg.tag("tags", "level"), F.lit("")) != "").cast("int")
    has_path = ((F.coalesce(tg.tag("tags", "highway"), F.lit("")) != "") | (F.coalesce(tg.tag("tags", "railway"), F.lit("")) != "")).cast("int")
    info = ways.select(F.col("id").alias("way_id"), tg.direction("tags").alias("dir"), has_level.alias("hl"), has_path.alias("hp"))
    segs = way_segments(ways).join(info, "way_id")
    legal = segs.where("dir >= 0").selectExpr("way_id", "hl", "hp", "node_from as a", "node_to as b").unionByName(
        segs.where("dir <= 0").selectExpr("way_id", "hl", "hp", "node_to as a", "node_from as b")).join(used, "a", "left_semi")
    best = steps.select("a", "b").distinct().join(legal, ["a", "b"]).groupBy("a", "b").agg(
        F.min_by("way_id", F.struct(-F.col("hl"), -F.col("hp"), F.col("way_id"))).alias("way_id"))
    return steps.join(best, ["a", "b"], "left").select("path_id", "seq", "a", "b", "way_id")


def hop_heights(hops: DataFrame, heights: DataFrame) -> DataFrame:
    """Both ends' heights of each hop (``za``, ``zb``): on its own way, else on any, else zero."""
    any_z = heights.groupBy("node_id").agg(F.min_by("z", "way_id").alias("z_any"))

    def end(side: str) -> DataFrame:
        return heights.select("way_id", F.col("node_id").alias(side), F.col("z").alias(f"z_{side}"))

    def fallback(side: str) -> DataFrame:
        return any_z.select(F.col("node_id").alias(side), F.col("z_any").alias(f"y_{side}"))

    return hops.join(end("a"), ["way_id", "a"], "left").join(end("b"), ["way_id", "b"], "left").join(
        fallback("a"), "a", "left").join(fallback("b"), "b", "left").select(
        "path_id", "seq", "a", "b", "way_id", F.coalesce("z_a", "y_a", F.lit(0.0)).alias("za"), F.coalesce("z_b", "y_b", F.lit(0.0)).alias("zb"))


def transitions(hops: DataFrame, heights: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Level changes of a path, at a node or along a way, and hops no mapped way covers.

    Returns ``path_id, seq, at, kind, node_id, way_id, from_z, to_z`` with ``at`` node, way or stitch.
    """
    z = hop_heights(hops, heights)
    order = Window.partitionBy("path_id").orderBy("seq")
    z = z.withColumn("before", F.lag("zb").over(order))
    node_kind = nodes.select(F.col("id").alias("a"), F.coalesce(tg.mechanism("tags"), F.lit("vertical")).alias("node_kind"))
    way_kind = ways.select(F.col("id").alias("way_id"), tg.way_kind("tags", tg.parse_levels(tg.tag("tags", "level"))).alias("way_kind"))
    full = z.join(node_kind, "a", "left").join(way_kind, "way_id", "left")
    at_node = F.when(F.abs(F.col("before") - F.col("za")) > 0.01, F.struct(
        F.lit("node").alias("at"), F.col("node_kind").alias("kind"), F.col("a").alias("node_id"), F.lit(None).cast("long").alias("way_id"),
        F.col("before").alias("from_z"), F.col("za").alias("to_z")))
    along = F.when(F.col("way_id").isNull() & (F.col("a") != F.col("b")), F.struct(
        F.lit("stitch").alias("at"), F.lit("stitch").alias("kind"), F.col("a").alias("node_id"), F.lit(None).cast("long").alias("way_id"),
        F.col("za").alias("from_z"), F.col("zb").alias("to_z"))).when(F.abs(F.col("za") - F.col("zb")) > 0.01, F.struct(
            F.lit("way").alias("at"), F.col("way_kind").alias("kind"), F.lit(None).cast("long").alias("node_id"), F.col("way_id"),
            F.col("za").alias("from_z"), F.col("zb").alias("to_z")))
    return full.select("path_id", "seq", F.explode(F.array(at_node, along)).alias("t")).where("t is not null").select("path_id", "seq", "t.*")


def attribute_transitions(changes: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names unexplained level changes at a node from the stair, escalator or lift beside it.

    Candidates must reach both heights (a way through the node need only overlap them) and pass
    within the near radius; failing that, one reaching both within the wide radius. Ties go to
    escalator, stairs, elevator. Segments and points meet on grid cells.
    """
    open_ = changes.where("at = 'node' and kind = 'vertical'").select("path_id", "seq", "node_id", "from_z", "to_z")
    spots = open_.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    levels = tg.parse_levels(tg.tag("tags", "level"))
    lifts = ways.where(tg.is_vertical_connector("tags")).withColumn("levels", levels)
    kinds = lifts.select(
        F.col("id").alias("way_id"), tg.way_kind("tags", F.col("levels")).alias("kind"),
        (F.array_min("levels") * M.FLOOR_HEIGHT_M).alias("lo"), (F.array_max("levels") * M.FLOOR_HEIGHT_M).alias("hi")
    ).where(F.col("kind").isin("escalator", "stairs", "elevator"))
    at = nodes.select(F.col("id").alias("n"), "lat", "lon")
    segs = way_segments(lifts).join(at.selectExpr("n as node_from", "lat as a_lat", "lon as a_lon"), "node_from").join(
        at.selectExpr("n as node_to", "lat as b_lat", "lon as b_lon"), "node_to")
    pad_lat, pad_lon = F.lit(lat_margin(M.ATTRIB_WIDE_RADIUS_M)), lon_margin(M.ATTRIB_WIDE_RADIUS_M, F.col("a_lat"))
    boxed = segs.select(
        "way_id", "a_lat", "a_lon", "b_lat", "b_lon",
        (F.least("a_lat", "b_lat") - pad_lat).alias("lat_lo"), (F.greatest("a_lat", "b_lat") + pad_lat).alias("lat_hi"),
        (F.least("a_lon", "b_lon") - pad_lon).alias("lon_lo"), (F.greatest("a_lon", "b_lon") + pad_lon).alias("lon_hi"))
    here = F.col("lat")
    near = in_boxes(spots, boxed, 0.002).withColumn("d2", segment_dist2(
        F.lit(0.0), F.lit(0.0), plane_x(F.col("a_lon"), F.col("lon"), here), plane_y(F.col("a_lat"), here),
        plane_x(F.col("b_lon"), F.col("lon"), here), plane_y(F.col("b_lat"), here)))
    per_way = near.groupBy("path_id", "seq", "node_id", "from_z", "to_z", "way_id").agg(F.min("d2").alias("d2")).join(kinds, "way_id")
    touch = node_ways(lifts).withColumn("on_node", F.lit(True))
    z_lo, z_hi, tol = F.least("from_z", "to_z"), F.greatest("from_z", "to_z"), M.ATTRIB_SLACK_M
    spans = (F.col("lo") <= z_lo + tol) & (F.col("hi") >= z_hi - tol)
    laps = F.coalesce("on_node", F.lit(False)) & (F.col("hi") >= z_lo - tol) & (F.col("lo") <= z_hi + tol)
    prio = F.when(F.col("kind") == "escalator", 0).when(F.col("kind") == "stairs", 1).otherwise(2)
    scored = per_way.join(touch, ["node_id", "way_id"], "left").withColumn(
        "close", (spans | laps) & (F.col("d2") <= M.ATTRIB_RADIUS_M ** 2)).withColumn(
        "wide", spans & (F.col("d2") <= M.ATTRIB_WIDE_RADIUS_M ** 2)).where("close or wide")
    named = scored.groupBy("path_id", "seq").agg(F.min_by(F.col("kind"), F.struct((~F.col("close")).alias("far"), "d2", prio.alias("p"))).alias("named"))
    return changes.join(named, ["path_id", "seq"], "left").withColumn("kind", F.when(
        (F.col("at") == "node") & (F.col("kind") == "vertical"), F.coalesce("named", "kind")).otherwise(F.col("kind"))).drop("named")


def platform_levels(platforms: DataFrame, ways: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """The floor of each platform way: own single level, else its walk endpoint, else the vote of
    the levelled ways that share a node with it (flat ways first); ties go to the lower floor."""
    levels = tg.parse_levels(tg.tag("tags", "level"))
    tagged = F.coalesce(tg.tag("tags", "level"), F.lit("")) != ""
    own = platforms.select("id", tg.tag("tags", "ref").alias("ref"), F.when(tagged & (F.size(levels) == 1), F.element_at(levels, 1)).alias("own"))
    rail = F.coalesce(tg.tag("tags", "railway").isin("platform", "platform_edge"), F.lit(False))
    voters = ways.where(tg.has_tag("tags", "level") & ~rail).withColumn("levels", levels)
    ballots = node_ways(voters).join(voters.select(F.col("id").alias("way_id"), "levels"), "way_id")
    met = platforms.select("id", F.explode(F.array_distinct("nodes")).alias("node_id")).join(ballots, "node_id").select(
        "id", "way_id", "levels").distinct()
    flat = F.size("levels") == 1
    votes = met.select("id", flat.alias("flat"), F.explode(F.when(flat, F.slice("levels", 1, 1)).otherwise(
        F.array(F.element_at("levels", 1), F.element_at("levels", -1)))).alias("level")).groupBy("id", "flat", "level").agg(F.count(F.lit(1)).alias("n"))
    vote = votes.groupBy("id").agg(F.min_by("level", F.struct((~F.col("flat")).alias("multi"), -F.col("n"), F.col("level"))).alias("vote"))
    out = own.join(vote, "id", "left")
    if endpoints is not None:
        out = out.join(endpoints.select("ref", F.col("level").alias("end")), "ref", "left")
    else:
        out = out.withColumn("end", F.lit(None).cast("double"))
    return out.select(F.col("id").alias("way_id"), F.rint(F.coalesce("own", "end", "vote")).cast("int").alias("level"))


def gate_platforms(candidates: DataFrame, anchors: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Platform ways (``relation_id, way_id``) near a rail anchor of their station and not of another mode.

    A station without anchors keeps all of its rail platforms.
    """
    rail = ways.where(tg.is_any_platform("tags") & ~tg.is_non_rail_platform("tags"))
    kept = candidates.join(rail.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    pts = kept.join(way_points(rail, nodes).select("way_id", "lat", "lon"), "way_id")
    near = radius_join(pts, anchors.select(F.col("relation_id").alias("a_rel"), "lat", "lon"), M.PLATFORM_KEEP_M).where(
        "relation_id = a_rel").select("relation_id", "way_id").distinct()
    free = kept.join(anchors.select("relation_id").distinct(), "relation_id", "left_anti")
    return near.unionByName(free.select("relation_id", "way_id"))


def marker_levels(markers: DataFrame, platform_points: DataFrame) -> DataFrame:
    """Each track marker takes the floor of the nearest platform vertex within the snap distance."""
    index = platform_points.where("level is not null").select("point_id", "level", "lat", "lon")
    hit = nearest(markers, index, M.MARKER_SNAP_M, tie="point_id").select("query_id", "track", "level")
    return markers.select("query_id", "track").join(hit, ["query_id", "track"], "left").withColumn(
        "z", F.coalesce(F.col("level") * M.FLOOR_HEIGHT_M, F.lit(0.0)))


def pois_near_path(pois: DataFrame, path_points: DataFrame, radius_m: float) -> DataFrame:
    """POIs within a radius of a path's vertices, with the smallest plane distance.

    ``path_points`` has ``path_id, lat, lon``; the plane's origin is the path's mean coordinate.
    """
    origin = origins(path_points, "path_id")
    index = pois.select(F.col("id").alias("poi_id"), "lat", "lon")
    near = radius_join(path_points.select("path_id", "lat", "lon"), index, radius_m * 1.02).join(origin, "path_id")
    lat0, lon0 = F.col("lat0"), F.col("lon0")
    d = F.hypot(plane_x(F.col("lon"), lon0, lat0) - plane_x(F.col("r_lon"), lon0, lat0), plane_y(F.col("lat"), lat0) - plane_y(F.col("r_lat"), lat0))
    return near.groupBy("path_id", "poi_id").agg(F.round(F.min(d), 1).alias("dist_m")).where(F.col("dist_m") <= radius_m)


def landmarks(pois: DataFrame, segments: DataFrame) -> DataFrame:
    """Named POIs beside a walked stretch of their own floor, one per name, the ten nearest.

    ``segments`` has ``path_id, a_lat, a_lon, b_lat, b_lon, level``; ``pois`` ``id, name, subtype, level, lat, lon``
    with a numeric floor in ``level``.
    """
    pad = M.LANDMARK_DIST_M * 1.02
    boxed = segments.select(
        "path_id", "a_lat", "a_lon", "b_lat", "b_lon", F.col("level").alias("s_level"),
        (F.least("a_lat", "b_lat") - lat_margin(pad)).alias("lat_lo"), (F.greatest("a_lat", "b_lat") + lat_margin(pad)).alias("lat_hi"),
        (F.least("a_lon", "b_lon") - lon_margin(pad, F.col("a_lat"))).alias("lon_lo"), (F.greatest("a_lon", "b_lon") + lon_margin(pad, F.col("a_lat"))).alias("lon_hi"))
    named = pois.where((F.coalesce("name", F.lit("")) != "") & ~F.coalesce(F.col("subtype").isin(*M.LANDMARK_DENIED), F.lit(False)))
    here = F.col("lat")
    near = in_boxes(named.select("id", "name", F.col("level").alias("p_level"), "lat", "lon"), boxed, 0.002).where("p_level = s_level")
    d = F.sqrt(segment_dist2(
        F.lit(0.0), F.lit(0.0), plane_x(F.col("a_lon"), F.col("lon"), here), plane_y(F.col("a_lat"), here),
        plane_x(F.col("b_lon"), F.col("lon"), here), plane_y(F.col("b_lat"), here)))
    per_poi = near.groupBy("path_id", "id", "name").agg(F.min(d).alias("dist_m")).where(F.col("dist_m") <= M.LANDMARK_DIST_M)
    per_name = per_poi.groupBy("path_id", F.lower(F.trim("name")).alias("key")).agg(
        F.min(F.struct("dist_m", "id", "name")).alias("b")).select("path_id", "b.*")
    order = Window.partitionBy("path_id").orderBy("dist_m", "id")
    return per_name.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= M.LANDMARK_LIMIT)


def walked_connectors(ways: DataFrame, path_ways: DataFrame, changes: DataFrame) -> DataFrame:
    """Stairs, escalators, lifts and ramps that a path uses: its ways (``path_id, way_id``) and those of its transitions."""
    kind = tg.way_kind("tags", tg.parse_levels(tg.tag("tags", "level")))
    connectors = ways.select(F.col("id").alias("way_id"), kind.alias("kind")).where(
        F.col("kind").isin("stairs", "escalator", "elevator", "ramp"))
    used = path_ways.select("path_id", "way_id").unionByName(changes.where("way_id is not null").select("path_id", "way_id"))
    return used.distinct().join(connectors, "way_id")
