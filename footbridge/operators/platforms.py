"""From a platform label to geometry: the tag ladder, stop and coordinate tiers, snaps, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.geo import haversine
from footbridge.functions.text import track_ref
from footbridge.operators.graph import node_ways, way_node_levels, way_points
from footbridge.operators.medians import weighted_medians
from footbridge.operators.spatial import in_boxes, nearest, points_in_rings, radius_join

MEDIAN_STEP_DEG = 1e-5  # about a metre: some 1400 steps across a harvest circle


def normalise_tracks(legs: DataFrame, *columns: str) -> DataFrame:
    """Strip label words such as ``Gleis`` from the given track columns of a legs table."""
    for c in columns:
        legs = legs.withColumn(c, track_ref(F.col(c)))
    return legs


# ---- the ladder ----------------------------------------------------------------

def _ladder_keys(ways: DataFrame) -> DataFrame:
    """Every key a platform way answers to, with the rung it answers on.

    Rungs: 1 edge ref, 2 edge track_ref holding the zero-padded ref, 3 area ref, 4 area
    local_ref, 5 any ref token, 6 any local_ref token. The substring rung is turned into
    equality by listing the substrings of the short track_ref, so the whole ladder is one
    equi-join.
    """
    ref, local = tg.tag("tags", "ref"), tg.tag("tags", "local_ref")
    track = tg.tag("tags", "railway:track_ref")

    def rung(n: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(n).alias("rung"), k.alias("key")))

    def when(flag: Column, keys: Column) -> Column:
        return F.when(flag, keys).otherwise(F.array().cast("array<string>"))

    pieces = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(track) - 1),
        lambda i: F.transform(
            F.sequence(F.lit(2), F.length(track) - i + 1), lambda n: F.substring(track, i, n)
        ),
    )))
    edge, area = tg.is_platform_edge("tags"), tg.is_platform_area("tags")
    keys = F.concat(
        rung(1, when(edge & ref.isNotNull(), F.array(ref))),
        rung(2, when(edge & (F.length(track) >= 2), pieces)),
        rung(3, when(area & ref.isNotNull(), F.array(ref))),
        rung(4, when(area & local.isNotNull(), F.array(local))),
        rung(5, tg.ref_tokens(ref)),
        rung(6, tg.ref_tokens(local)),
    )
    return ways.where(tg.is_any_platform("tags")).select(
        F.col("id").alias("way_id"), F.explode(keys).alias("k")
    ).select("way_id", "k.rung", "k.key").distinct()


def resolve_platforms(requests: DataFrame, footprint: DataFrame, ways: DataFrame) -> DataFrame:
    """All ways of the first rung that hits, per (relation, ref).

    ``requests`` has ``relation_id, ref``; ``footprint`` bounds ways to stations.
    """
    asked = requests.select("relation_id", "ref").where("ref is not null").distinct()
    padded = F.when(F.length("ref") < 2, F.lpad("ref", 2, "0")).otherwise(F.col("ref"))
    wanted = asked.select("relation_id", "ref", F.col("ref").alias("key"), F.lit(False).alias("by_part")).unionByName(
        asked.select("relation_id", "ref", padded.alias("key"), F.lit(True).alias("by_part"))
    )
    keyed = footprint.join(_ladder_keys(ways), "way_id").withColumn("by_part", F.col("rung") == 2)
    hits = wanted.join(keyed, ["relation_id", "key", "by_part"]).select("relation_id", "ref", "way_id", "rung").distinct()
    per_request = Window.partitionBy("relation_id", "ref")
    return hits.withColumn("best", F.min("rung").over(per_request)).where("rung = best").drop("best")


def way_anchors(resolved: DataFrame, points: DataFrame) -> DataFrame:
    """A resolved platform's start or goal vertices: all located nodes of its ways."""
    return resolved.select("relation_id", "ref", "way_id").join(
        points.select("way_id", "node_id"), "way_id"
    ).select("relation_id", "ref", "way_id", "node_id").distinct()


# ---- snaps -----------------------------------------------------------------------

def snap_to_way(
    spots: DataFrame, ways: DataFrame, nodes: DataFrame, qualifies: Column, radius_m: float = M.STOP_SNAP_M,
) -> DataFrame:
    """The nearest node owning a qualifying way, as ``way_id`` and ``anchor``.

    ``spots`` has ``lat, lon`` and any keys. Filtering the ways first means only nodes that can
    win enter the spatial join.
    """
    owned = way_points(ways.where(qualifies), nodes)
    # the lowest way id stands for a node with several qualifying ways
    sites = owned.groupBy("node_id", "lat", "lon").agg(F.min("way_id").alias("way_id")).withColumnRenamed(
        "node_id", "anchor")
    return nearest(spots, sites, radius_m, tie="anchor").drop("r_lat", "r_lon").withColumnRenamed(
        "dist_m", "snap_m")


def resolve_by_stop(
    misses: DataFrame, boxes: DataFrame, stops: DataFrame, ways: DataFrame, nodes: DataFrame,
) -> DataFrame:
    """Refs found only on a stop node: the one nearest the box centre, snapped to a walkable way."""
    asked = misses.select("relation_id", "ref").distinct()
    wanted = boxes.join(asked.select("relation_id").distinct(), "relation_id", "left_semi")
    # stops meet the boxes that hold them first: a ref such as 6 is used at most stations
    inside = (
        in_boxes(stops.select("ref", F.col("node_id").alias("stop_id"), "lat", "lon"), wanted)
        .join(asked, ["relation_id", "ref"])
        .withColumn("centre_m", haversine(
            (F.col("lat_lo") + F.col("lat_hi")) / 2, (F.col("lon_lo") + F.col("lon_hi")) / 2, "lat", "lon"))
    )
    stop = inside.groupBy("relation_id", "ref").agg(
        F.min_by(F.struct("lat", "lon"), F.struct("centre_m", "stop_id")).alias("s")
    ).select("relation_id", "ref", "s.lat", "s.lon")
    return snap_to_way(stop, ways, nodes, tg.is_walkable("tags"))


def resolve_by_coord(misses: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Refs nothing on the map carries: the caller's coordinate, snapped to a pedestrian way."""
    return snap_to_way(
        misses.where("lat is not null and lon is not null"), ways, nodes, tg.is_pedestrian("tags")
    ).withColumn("by_coord", F.lit(True))


def isolated_platforms(platforms: DataFrame, ways: DataFrame) -> DataFrame:
    """Platforms (``platform, way_id``) none of whose nodes lies on another walkable way."""
    touch = node_ways(ways.where(tg.is_walkable("tags")))
    own = platforms.select("platform", "way_id").distinct()
    members = own.join(node_ways(ways), "way_id").select("platform", "node_id").distinct()
    linked = members.join(touch, "node_id").join(own, ["platform", "way_id"], "left_anti").select(
        "platform").distinct()
    return own.select("platform").distinct().join(linked, "platform", "left_anti")


def recover_isolated(
    isolated: DataFrame, platforms: DataFrame, ways: DataFrame, nodes: DataFrame,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Join an isolated platform to the nearest on-level pedestrian way that leads somewhere.

    ``platforms`` has ``platform, way_id``. A platform with one tagged level only takes a way
    within half a floor of it; a way that is itself an island is skipped.
    """
    own = platforms.join(isolated, "platform", "left_semi").select("platform", "way_id").distinct()
    tagged = own.join(ways.select(F.col("id").alias("way_id"), tg.tag("tags", "level").alias("raw")), "way_id").where(
        "raw is not null and raw <> ''")
    floors = tagged.select("platform", F.explode(tg.parse_levels(F.col("raw"))).alias("floor")).groupBy("platform").agg(
        F.when(F.count_distinct("floor") == 1, F.min("floor")).alias("floor"))
    own_points = own.join(way_points(ways, nodes), "way_id").select("platform", "node_id", "lat", "lon").distinct()
    start = own_points if anchors is None else own_points.join(
        anchors.select("platform", "node_id").distinct(), ["platform", "node_id"], "left_semi")
    targets = nodes.where("lat is not null").select(F.col("id").alias("anchor"), "lat", "lon")
    near = (
        radius_join(start.select("platform", "lat", "lon"), targets, M.STOP_SNAP_M)
        .groupBy("platform", "anchor").agg(F.min("dist_m").alias("snap_m"))
        .join(start.select("platform", F.col("node_id").alias("anchor")), ["platform", "anchor"], "left_anti")
    )
    levels = way_node_levels(ways.where(tg.is_pedestrian("tags")), nodes).withColumnRenamed("node_id", "anchor")
    options = (
        near.join(levels, "anchor").join(own, ["platform", "way_id"], "left_anti")
        .join(floors, "platform", "left")
        .where(F.col("floor").isNull() | (F.abs(F.col("level") - F.col("floor")) <= M.LEVEL_DELTA))
    )
    # a way leads on if some node of it lies on a third walkable way
    touch = node_ways(ways.where(tg.is_walkable("tags")))
    candidates = options.select("platform", "way_id").distinct()
    onward = (
        candidates.join(node_ways(ways), "way_id").join(touch.withColumnRenamed("way_id", "other"), "node_id")
        .where("other <> way_id").select("platform", "way_id", "other").distinct()
        .join(own.withColumnRenamed("way_id", "other"), ["platform", "other"], "left_anti")
        .select("platform", "way_id").distinct()
    )
    return (
        options.join(onward, ["platform", "way_id"], "left_semi")
        .groupBy("platform").agg(F.min_by(
            F.struct("way_id", "anchor", "snap_m"), F.struct("snap_m", "anchor", "way_id")).alias("s"))
        .select("platform", "s.*")
    )


# ---- lists, centroids, labels ------------------------------------------------------

def platform_refs(footprint: DataFrame, ways: DataFrame) -> DataFrame:
    """The distinct platform refs of each station with their natural-order position."""
    tokens = F.array_union(tg.ref_tokens(tg.tag("tags", "ref")), tg.ref_tokens(tg.tag("tags", "local_ref")))
    per_way = ways.where(tg.is_any_platform("tags")).select(
        F.col("id").alias("way_id"), F.explode(tokens).alias("ref"))
    refs = footprint.join(per_way, "way_id").select("relation_id", "ref").distinct()
    order = Window.partitionBy("relation_id").orderBy(tg.natural_key(F.col("ref")), "ref")
    return refs.withColumn("ord", F.row_number().over(order) - 1)


def platform_centroids(footprint: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (station, ref): the mean of its ways' mean coordinates."""
    kept = ways.where(tg.is_any_platform("tags"))
    centre = way_points(kept, nodes).groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    tokens = F.array_union(tg.ref_tokens(tg.tag("tags", "ref")), tg.ref_tokens(tg.tag("tags", "local_ref")))
    refs = kept.select(F.col("id").alias("way_id"), F.explode(tokens).alias("ref")).distinct()
    return footprint.join(refs.join(centre, "way_id"), "way_id").groupBy("relation_id", "ref").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def nearest_label(spots: DataFrame, track_nodes: DataFrame, radius_m: float = M.LABEL_RADIUS_M) -> DataFrame:
    """The public track number nearest each spot; ``track_nodes`` from ``numeric_track_nodes``."""
    labels = track_nodes.select("node_id", F.col("ref").alias("label"), "lat", "lon")
    return nearest(spots, labels, radius_m, tie="node_id").withColumnRenamed("dist_m", "label_m").drop("r_lat", "r_lon")


def quay_at(spots: DataFrame, quays: DataFrame, radius_m: float = M.QUAY_RADIUS_M) -> DataFrame:
    """The nearest operator quay of each spot: its label and access flags."""
    index = quays.select(
        F.concat_ws("|", "station_key", "public_label").alias("quay_key"),
        "public_label", "step_free", "wheelchair", "has_lift", "lat", "lon")
    return nearest(spots, index, radius_m, tie="quay_key").withColumnRenamed("dist_m", "quay_m").drop("r_lat", "r_lon")


def combine_access(changes: DataFrame) -> DataFrame:
    """Access of a whole change from its two ends' flags.

    Step-free only when both ends are rated; a lift counts at either end. SQL's AND would turn
    (false, unknown) into false, so the null case is spelled out.
    """
    a, b = F.col("arr_step_free"), F.col("dep_step_free")
    la, lb = F.col("arr_has_lift"), F.col("dep_has_lift")
    return changes.withColumn(
        "step_free", F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)
    ).withColumn(
        "has_lift", F.when(la.isNull() & lb.isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.coalesce(la, F.lit(False)) | F.coalesce(lb, F.lit(False)))
    )


# ---- the label overlay --------------------------------------------------------------

def complex_markers(queries: DataFrame, overlay: DataFrame) -> DataFrame:
    """All overlay tracks of the station complex nearest each query point.

    ``overlay`` is flat (``station, st_lat, st_lon, track, lat, lon, n``). The complex is every
    entry within the merge radius of the nearest one; a track kept twice goes to the entry
    closer to that anchor. ``complex_name`` is the entry with most tracks.
    """
    stations = overlay.groupBy("station").agg(
        F.first("st_lat").alias("lat"), F.first("st_lon").alias("lon"), F.count("track").alias("n_tracks"))
    anchored = nearest(
        queries.select("query_id", "lat", "lon"), stations.select("station", "lat", "lon"),
        M.OVERLAY_MAX_M, tie="station",
    ).select("query_id", F.col("station").alias("anchor"), F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
    # clusters depend on the anchor only, so they are built once per anchor
    anchors = anchored.select("anchor", "lat", "lon").distinct()
    cluster = radius_join(anchors, stations, M.OVERLAY_MERGE_M).select("anchor", "station", "n_tracks", "dist_m")
    names = cluster.groupBy("anchor").agg(
        F.min_by("station", F.struct(-F.col("n_tracks"), F.col("dist_m"), F.col("station"))).alias("complex_name"))
    tracks = (
        cluster.join(overlay.select("station", "track", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), "station")
        .where("track is not null")
        .groupBy("anchor", "track").agg(F.min_by(
            F.struct("t_lat", "t_lon"), F.struct("dist_m", "station")).alias("t"))
        .select("anchor", "track", F.col("t.t_lat").alias("t_lat"), F.col("t.t_lon").alias("t_lon"))
    )
    return anchored.select("query_id", "anchor").join(names, "anchor").join(tracks, "anchor").select(
        "query_id", "complex_name", "track", "t_lat", "t_lon")


def anchor_coords(requests: DataFrame, station_points: DataFrame, overlay: DataFrame) -> DataFrame:
    """(station, track) to the overlay coordinate of that track in the station's complex."""
    where_is = station_points.select(F.col("relation_id").alias("query_id"), "lat", "lon")
    asked = requests.select("relation_id", "ref").distinct()
    markers = complex_markers(
        where_is.join(asked.select(F.col("relation_id").alias("query_id")).distinct(), "query_id", "left_semi"), overlay)
    return asked.join(
        markers.select(F.col("query_id").alias("relation_id"), F.col("track").alias("ref"), "t_lat", "t_lon"),
        ["relation_id", "ref"], "left")


def station_platforms(refs: DataFrame, markers: DataFrame) -> DataFrame:
    """Map refs united with overlay tracks, in natural order."""
    both = refs.select("relation_id", "ref").unionByName(
        markers.select(F.col("query_id").alias("relation_id"), F.col("track").alias("ref"))).distinct()
    order = Window.partitionBy("relation_id").orderBy(tg.natural_key(F.col("ref")), "ref")
    return both.withColumn("ord", F.row_number().over(order) - 1)


def merge_feed(platforms: DataFrame, rail_stations: DataFrame, radius_m: float = M.RAIL_FILTER_M) -> DataFrame:
    """Feed platforms keyed to the nearest rail station; others dropped, codes kept once.

    ``platforms`` has ``seq, code, lat, lon``; the first in feed order wins per code.
    """
    stations = rail_stations.select("node_id", F.col("name").alias("station"), "lat", "lon")
    matched = nearest(platforms.select("seq", "code", "lat", "lon"), stations, radius_m, tie="node_id")
    return matched.groupBy("station", "code").agg(F.min_by(
        F.struct(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                 F.col("r_lat").alias("st_lat"), F.col("r_lon").alias("st_lon")), F.col("seq")).alias("p"),
        F.count(F.lit(1)).alias("n")).select("station", "code", "p.*", "n")


def harvest_labels(stops: DataFrame, targets: DataFrame, radius_m: float = M.HARVEST_RADIUS_M) -> DataFrame:
    """Median coordinate and count of every track seen near each target station.

    ``stops`` has ``track, lat, lon`` from leg ends and stopovers; ``targets`` ``station, lat, lon``.
    Copies of an observation are counted first, and medians are found by selection, so no task holds a busy track.
    """
    seen = stops.where("track is not null").groupBy("track", "lat", "lon").agg(F.count(F.lit(1)).alias("w"))
    # the stations are the side that is repeated for neighbour cells
    near = radius_join(targets.select("station", "lat", "lon"), seen, radius_m)
    axes = near.select("station", "track", "w", F.explode(F.create_map(
        F.lit("lat"), F.col("r_lat"), F.lit("lon"), F.col("r_lon"))).alias("axis", "v"))
    middle = weighted_medians(axes, ["station", "track", "axis"], MEDIAN_STEP_DEG)
    return middle.groupBy("station", "track").agg(
        *[F.round(F.max(F.when(F.col("axis") == a, F.col("median"))), 6).alias(a) for a in ("lat", "lon")], F.max("n").alias("n"))


def harvest_candidates(
    stations: DataFrame, ways: DataFrame, nodes: DataFrame, min_unlabelled: int = 1,
) -> DataFrame:
    """Stations with platforms in a fixed box around them that carry no label."""
    dlat, dlon = M.HARVEST_BOX_DEG
    boxes = stations.select(
        F.col("node_id").alias("station_id"), "name",
        (F.col("lat") - dlat).alias("lat_lo"), (F.col("lat") + dlat).alias("lat_hi"),
        (F.col("lon") - dlon).alias("lon_lo"), (F.col("lon") + dlon).alias("lon_hi"))
    kept = ways.where(tg.is_any_platform("tags"))
    points = way_points(kept, nodes, (tg.has_tag("tags", "ref") | tg.has_tag("tags", "local_ref")).alias("labelled"))
    pairs = in_boxes(points.select("way_id", "labelled", "lat", "lon"), boxes).select(
        "station_id", "name", "way_id", "labelled").distinct()
    counts = pairs.groupBy("station_id", "name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("labelled").alias("labelled"))
    return counts.withColumn("unlabelled", F.col("total") - F.col("labelled")).where(
        F.col("unlabelled") >= min_unlabelled)


# ---- stitches -----------------------------------------------------------------------

def stitch_bridges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connector nodes lying inside a platform polygon on a shared level, with its nearest node."""
    areas = ways.where(tg.is_platform_area("tags"))
    vertices = way_points(areas, nodes)
    order = Window.partitionBy("way_id").orderBy("pos")
    rings = vertices.select(
        F.col("way_id").alias("ring_id"), (F.row_number().over(order) - 1).alias("pos"), "lat", "lon")
    connectors = ways.where(tg.is_stitch_connector("tags"))
    levels = tg.parse_levels(tg.tag("tags", "level"))
    touch = way_points(connectors, nodes, levels.alias("levels"))
    spots = touch.select(F.col("node_id").alias("id"), "lat", "lon").distinct()
    inside = points_in_rings(spots, rings).join(
        vertices.select(F.col("way_id").alias("ring_id"), F.col("node_id").alias("id")).distinct(),
        ["ring_id", "id"], "left_anti")
    area_levels = areas.select(F.col("id").alias("ring_id"), levels.alias("area_levels"))
    fits = (
        inside.join(area_levels, "ring_id")
        .join(touch.select(F.col("node_id").alias("id"), "levels").distinct(), "id")
        .where(F.arrays_overlap("area_levels", "levels"))
        .select("ring_id", "id", "lat", "lon").distinct()
    )
    return (
        fits.join(vertices.select(
            F.col("way_id").alias("ring_id"), F.col("node_id").alias("node_b"),
            F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).distinct(), "ring_id")
        .withColumn("d", haversine("lat", "lon", "b_lat", "b_lon"))
        .groupBy("ring_id", "id").agg(F.min(F.struct("d", "node_b")).alias("m"))
        .select(F.col("id").alias("node_a"), F.col("m.node_b").alias("node_b"),
                F.round("m.d", 2).alias("dist_m"), F.col("ring_id").alias("platform_way"))
        .groupBy("node_a", "node_b").agg(F.min_by(
            F.struct("dist_m", "platform_way"), F.col("platform_way")).alias("s"))
        .select("node_a", "node_b", "s.*")
    )


def station_points(closure: DataFrame, relations: DataFrame, nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Each station's centre: mean of its node members, or of its ways' nodes when it has none."""
    stations = relations.where(tg.tag("tags", "public_transport").isin("stop_area", "stop_area_group")).select(
        F.col("id").alias("relation_id"), tg.tag("tags", "name").alias("name"), tg.tag("tags", "country").alias("country"))
    at = nodes.where("lat is not null").select(F.col("id").alias("node_id"), "lat", "lon")
    mine = closure.join(stations.select("relation_id"), "relation_id", "left_semi")

    def mean(points: DataFrame) -> DataFrame:
        return points.join(at, "node_id").groupBy("relation_id").agg(
            F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n_members"))

    direct = mean(mine.where("member_type = 'N'").select("relation_id", F.col("member_ref").alias("node_id")).distinct())
    by_way = mean(
        mine.where("member_type = 'W'").join(direct, "relation_id", "left_anti")
        .select("relation_id", F.col("member_ref").alias("id")).distinct()
        .join(ways.select("id", "nodes"), "id").select("relation_id", F.explode("nodes").alias("node_id")))
    return stations.join(direct.unionByName(by_way), "relation_id")
