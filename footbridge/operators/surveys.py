"""Connectivity surveys and facility lookups for all stations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.geo import haversine, lat_margin, lon_margin
from footbridge.operators.spatial import in_boxes


def sweep_universe(
    members: DataFrame, relations: DataFrame, nodes: DataFrame, stations: DataFrame, region: str | None = None,
) -> DataFrame:
    """Rail stop areas with at least two platform members, optionally inside a region's box."""
    areas = relations.where(tg.tag("tags", "public_transport").isin("stop_area", "stop_area_group")).select(
        F.col("id").alias("relation_id"))
    rail_nodes = nodes.where(tg.tag("tags", "railway").isin("station", "halt")).select(F.col("id").alias("member_ref"))
    rail = members.where("member_type = 'N'").join(rail_nodes, "member_ref", "left_semi").select("relation_id").distinct()
    plat = members.where("member_role = 'platform'").groupBy("relation_id").agg(F.count(F.lit(1)).alias("n_platforms"))
    out = stations.select("relation_id", "name", "lat", "lon").join(areas, "relation_id", "left_semi").join(
        rail, "relation_id", "left_semi").join(plat.where("n_platforms >= 2"), "relation_id")
    if region is not None:
        lat_lo, lat_hi, lon_lo, lon_hi = M.SURVEY_REGIONS[region]
        out = out.where(F.col("lat").between(lat_lo, lat_hi) & F.col("lon").between(lon_lo, lon_hi))
    return out


def survey_pairs(refs: DataFrame, cap: int | None = None) -> DataFrame:
    """All unordered platform pairs per station; with ``cap``, pairs of an even stride of at most that many refs."""
    if cap is None:
        return _pairs(refs)
    sized = refs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("relation_id")))
    # ref number k is kept if some i < cap has floor(i * n / cap) = k
    i = F.ceil(F.col("ord") * cap / F.col("n"))
    kept = sized.where((F.col("n") <= cap) | ((i < cap) & (F.floor(i * (F.col("n") / cap)) == F.col("ord"))))
    return _pairs(kept)


def _pairs(kept: DataFrame) -> DataFrame:
    a = kept.select("relation_id", F.col("ref").alias("from_ref"), F.col("ord").alias("a"))
    b = kept.select("relation_id", F.col("ref").alias("to_ref"), F.col("ord").alias("b"))
    return a.join(b, "relation_id").where("a < b").select(
        "relation_id", "from_ref", "to_ref", F.col("a").alias("from_ord"), F.col("b").alias("to_ord"))


def pair_classes(pairs: DataFrame, plain: DataFrame, stitched: DataFrame) -> DataFrame:
    """connected / stitchable / island from the plain walks and the stitched walks of the misses."""
    keys = ["relation_id", "from_ref", "to_ref"]
    p = plain.select(*keys, F.col("found").alias("plain_found"))
    s = stitched.select(*keys, F.col("found").alias("stitched_found"))
    return pairs.join(p, keys, "left").join(s, keys, "left").withColumn(
        "kind", F.when(F.coalesce("plain_found", F.lit(False)), F.lit(M.CONNECTED))
        .when(F.coalesce("stitched_found", F.lit(False)), F.lit(M.STITCHABLE)).otherwise(F.lit(M.ISLAND))
    ).drop("plain_found", "stitched_found")


def station_health(classes: DataFrame, refs: DataFrame, cap: int | None = None) -> DataFrame:
    """Counts and shares per station, with up to six unconnected pairs, stitchable ones first.

    ``cap`` is the one that the pairs were drawn with; above it a station counts as sampled."""
    sizes = refs.groupBy("relation_id").agg(F.count(F.lit(1)).alias("platform_count"))
    counts = classes.groupBy("relation_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("kind") == M.CONNECTED).alias("connected"),
        F.count_if(F.col("kind") == M.STITCHABLE).alias("stitchable"), F.count_if(F.col("kind") == M.ISLAND).alias("island"))
    order = Window.partitionBy("relation_id").orderBy(F.col("kind") != M.STITCHABLE, "from_ord", "to_ord")
    shown = classes.where(F.col("kind") != M.CONNECTED).withColumn("k", F.row_number().over(order)).where(
        F.col("k") <= M.HEALTH_EXAMPLES)
    examples = shown.groupBy("relation_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", F.concat("from_ref", F.lit(">"), "to_ref", F.lit(":"), "kind").alias("t")))),
        lambda s: s["t"]), ",").alias("examples"))

    def pct(c: str):
        return F.round(F.when(F.coalesce("pairs", F.lit(0)) > 0, 100.0 * F.col(c) / F.col("pairs")).otherwise(0.0), 1)

    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pairs", "connected", "stitchable", "island")}
    return sizes.join(counts, "relation_id", "left").join(examples, "relation_id", "left").withColumns(zero).withColumn(
        "sampled", F.lit(False) if cap is None else F.col("platform_count") > cap).withColumns(
        {f"{c}_pct": pct(c) for c in ("connected", "stitchable", "island")})


def sweep_rows(universe: DataFrame, health: DataFrame) -> DataFrame:
    """One result row per station of the universe: classified, or too few platforms."""
    return universe.select("relation_id").join(health, "relation_id", "left").select(
        "relation_id",
        F.when(F.coalesce("platform_count", F.lit(0)) < 2, "no_platforms").otherwise("ok").alias("status"),
        F.coalesce("platform_count", F.lit(0)).alias("platform_count"), F.coalesce("sampled", F.lit(False)).alias("sampled"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "connected", "stitchable", "island")])


def sweep_report(results: DataFrame) -> DataFrame:
    """Totals of a sweep: stations by status, pairs by class, fully connected stations."""
    ok = F.col("status") == "ok"

    def total(c: str):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))

    sums = results.agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(ok).alias("classified"),
        F.count_if(F.col("status") == "no_platforms").alias("no_platforms"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(ok & F.col("sampled")).alias("sampled"),
        *[total(c).alias(c) for c in ("pairs", "connected", "stitchable", "island")],
        F.count_if(ok & (F.col("pairs") > 0) & (F.col("pairs") == F.col("connected"))).alias("fully_connected"))
    return sums.withColumns({
        f"{c}_pct": F.round(100.0 * F.col(c) / F.nullif(F.col("pairs"), F.lit(0)), 1) for c in ("connected", "stitchable", "island")})


# ---- facilities ---------------------------------------------------------------------

def canonical_category(category):
    """A requested category in its canonical spelling, null when unknown."""
    key = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for kv in M.FACILITY_ALIASES.items() for x in kv])
    key = F.coalesce(F.try_element_at(aliases, key), key)
    return F.when(key.isin(*M.FACILITY_CLAUSES), key)


def _clauses(spark) -> DataFrame:
    """The category taxonomy as a table of about twenty rows (a fixed size, safe to broadcast)."""
    rows = [(k, cat, s) for k, parts in M.FACILITY_CLAUSES.items() for cat, subs in parts for s in (subs or [None])]
    return spark.createDataFrame(rows, "kind string, category string, wanted string")


def facilities(asked: DataFrame, stations: DataFrame, pois: DataFrame, limit: int = M.FACILITY_LIMIT) -> DataFrame:
    """The facilities of a category near each asked station, nearest first, or a reason.

    ``asked`` has ``relation_id, category``. One row per facility; a station without any has one
    row with its reason.
    """
    wanted = asked.select("relation_id", "category", canonical_category(F.col("category")).alias("kind"))
    placed = wanted.join(stations.select("relation_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "relation_id", "left")
    # box members are found once per station; its categories only filter them
    boxes = placed.where("kind is not null and s_lat is not null").select("relation_id", "s_lat", "s_lon").distinct().select(
        "*", (F.col("s_lat") - lat_margin(M.FACILITY_RADIUS_M)).alias("lat_lo"),
        (F.col("s_lat") + lat_margin(M.FACILITY_RADIUS_M)).alias("lat_hi"),
        (F.col("s_lon") - lon_margin(M.FACILITY_RADIUS_M, F.col("s_lat"), 0.01)).alias("lon_lo"),
        (F.col("s_lon") + lon_margin(M.FACILITY_RADIUS_M, F.col("s_lat"), 0.01)).alias("lon_hi"))
    index = pois.select(F.col("id").alias("poi_id"), F.col("category").alias("poi_category"), "subtype",
                        F.col("name").alias("poi_name"), F.nullif(F.trim("level"), F.lit("")).alias("poi_level"), "lat", "lon")
    taxonomy = F.broadcast(_clauses(asked.sparkSession).withColumnRenamed("category", "poi_category"))
    near = in_boxes(index, boxes).join(taxonomy, "poi_category").where("wanted is null or wanted = subtype").select(
        "relation_id", "kind", "poi_id", "poi_category", "subtype", "poi_name", "poi_level", "lat", "lon",
        F.round(haversine("s_lat", "s_lon", "lat", "lon"), 1).alias("distance_m")).distinct()
    ranked = near.withColumn("rank", F.row_number().over(
        Window.partitionBy("relation_id", "kind").orderBy("distance_m", "poi_id"))).where(F.col("rank") <= limit)
    loaded = pois.limit(1).agg((F.count(F.lit(1)) > 0).alias("loaded"))
    out = placed.join(ranked, ["relation_id", "kind"], "left").crossJoin(F.broadcast(loaded))
    return out.withColumn("reason", F.when(F.col("kind").isNull(), F.lit(M.UNSUPPORTED_CATEGORY))
                          .when(F.col("s_lat").isNull(), F.lit(M.STATION_UNRESOLVED))
                          .when(~F.col("loaded"), F.lit(M.NO_POI_LAYER))
                          .when(F.col("poi_id").isNull(), F.lit(M.NONE_MAPPED))).drop("s_lat", "s_lon", "loaded")


def facility_walks(found: DataFrame, centroids: DataFrame, walks: DataFrame, from_ref) -> DataFrame:
    """Each facility's nearest platform and the walk there; the own platform is no walk.

    A station has a few dozen platforms, and the minimum is taken map-side.
    """
    plats = centroids.select("relation_id", F.col("ref").alias("platform"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    nearest = found.select("relation_id", "poi_id", "lat", "lon").distinct().join(plats, "relation_id").groupBy("relation_id", "poi_id").agg(
        F.min_by("platform", F.struct(haversine("lat", "lon", "p_lat", "p_lon"), "platform")).alias("nearest_platform"))
    routed = walks.select("relation_id", "from_ref", F.col("to_ref").alias("nearest_platform"), "seconds", "metres")
    out = found.join(nearest, ["relation_id", "poi_id"], "left").withColumn("from_ref", from_ref).join(
        routed, ["relation_id", "from_ref", "nearest_platform"], "left")
    here = F.col("nearest_platform") == F.col("from_ref")
    return out.withColumn("walk_s", F.when(here, 0.0).otherwise(F.col("seconds"))).withColumn(
        "walk_m", F.when(here, 0.0).otherwise(F.col("metres"))).drop("seconds", "metres")
