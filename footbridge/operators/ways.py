"""Filter and label jobs over ways and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge.functions import tags as tg


def walkable(ways: DataFrame) -> DataFrame:
    """Everything but station outlines, untagged geometry included."""
    return ways.where(tg.is_walkable("tags"))


def classify_ways(ways: DataFrame) -> DataFrame:
    """The platform, pedestrian and connector flags used by every resolver, computed once."""
    return ways.select(
        "*",
        tg.is_platform_edge("tags").alias("is_edge"),
        tg.is_platform_area("tags").alias("is_area_platform"),
        tg.is_any_platform("tags").alias("is_platform"),
        tg.is_pedestrian("tags").alias("is_pedestrian"),
        tg.is_stitch_connector("tags").alias("is_connector"),
        tg.is_walkable("tags").alias("is_walkable"),
    )


def station_stops(nodes: DataFrame) -> DataFrame:
    """Rail stop nodes with a track ref; road, tram and ferry stops only if also tagged rail."""
    ref = F.coalesce(F.nullif(tg.tag("tags", "ref"), F.lit("")), tg.tag("tags", "local_ref"))

    def yes(key: str, value: str = "yes"):
        return F.coalesce(tg.tag("tags", key), F.lit("")) == value

    stop = yes("railway", "stop") | yes("public_transport", "stop_position")
    other_mode = yes("bus") | yes("tram") | yes("trolleybus") | yes("ferry") | yes("highway", "bus_stop")
    rail = yes("railway", "stop") | yes("train") | yes("subway") | yes("light_rail")
    return nodes.where(stop & ref.isNotNull() & ~(other_mode & ~rail)).select(
        F.col("id").alias("node_id"), ref.alias("ref"), "lat", "lon"
    )


def rail_platforms(ways: DataFrame) -> DataFrame:
    """Platform ways not tagged for tram, bus, trolleybus or road."""
    return ways.where(tg.is_any_platform("tags") & ~tg.is_non_rail_platform("tags"))


def label_kinds(ways: DataFrame) -> DataFrame:
    """Stairs, escalator, elevator, ramp, platform or walkway; connector and area flags."""
    levels = tg.parse_levels(tg.tag("tags", "level"))
    return ways.select(
        F.col("id").alias("way_id"),
        tg.way_kind("tags", levels).alias("kind"),
        tg.is_level_connector("tags", levels).alias("connector"),
        tg.is_area("tags", F.col("nodes")).alias("area"),
    )


def label_node_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("id").alias("node_id"), F.coalesce(tg.mechanism("tags"), F.lit("vertical")).alias("kind")
    )


def rail_stations(nodes: DataFrame) -> DataFrame:
    """Named station and halt nodes: the rail filter and the merge key of label feeds."""
    return nodes.where(
        tg.tag("tags", "railway").isin("station", "halt") & (F.coalesce(tg.tag("tags", "name"), F.lit("")) != "")
    ).select(F.col("id").alias("node_id"), tg.tag("tags", "name").alias("name"), "lat", "lon")


def numeric_track_nodes(nodes: DataFrame) -> DataFrame:
    """Stop nodes whose ref is a bare number, tram stops excluded."""
    railway = tg.tag("tags", "railway")
    stop = railway.isin("stop", "stop_position") | (tg.tag("tags", "public_transport") == "stop_position")
    ref = tg.tag("tags", "ref")
    return nodes.where(
        F.coalesce(stop, F.lit(False)) & ~railway.eqNullSafe(F.lit("tram_stop")) & ref.rlike("^[0-9]+$")
    ).select(F.col("id").alias("node_id"), ref.alias("ref"), "lat", "lon")
