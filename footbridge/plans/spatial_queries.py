"""Registered queries over spatial joins, platform resolution and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from footbridge.functions import tags as tg
from footbridge.functions.text import track_ref
from footbridge.operators import platforms, spatial, ways as way_ops
from footbridge.plans.graph_queries import stations
from footbridge.plans.registry import SHARED_VIEWS, hav, query
from footbridge.plans.stations import resolve_ends
from footbridge.plans.world import World

AREA_RINGS = """
SELECT wn.way_id AS ring_id, wn.pos, n.lat, n.lon FROM {fx_way_nodes} wn JOIN {fx_nodes} n ON n.id=wn.node_id WHERE wn.way_id%1000>=200 AND wn.way_id%1000<300"""
SHARED_VIEWS["o_ring"] = AREA_RINGS
SHARED_VIEWS["o_ring_edge"] = """
SELECT ring_id, lat AS lat_i, lon AS lon_i, coalesce(lag(lat) OVER q, last_value(lat) OVER r) AS lat_j, coalesce(lag(lon) OVER q, last_value(lon) OVER r) AS lon_j
FROM {o_ring} WINDOW q AS (PARTITION BY ring_id ORDER BY pos), r AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
SHARED_VIEWS["o_inside"] = """
SELECT n.id, e.ring_id FROM {o_ring_edge} e JOIN {fx_nodes} n ON n.st=CAST(floor(e.ring_id/1000.0) AS BIGINT)
WHERE (lon_i>n.lon)<>(lon_j>n.lon) AND n.lat<(lat_j-lat_i)*(n.lon-lon_i)/(lon_j-lon_i)+lat_i GROUP BY n.id, e.ring_id HAVING count(*)%2=1"""


@query("points_in_polygons", "O-33", "SELECT id, ring_id FROM {o_inside}")
def points_in_polygons(w: World):
    rings = w.view("fx_way_nodes").where("way_id % 1000 >= 200 and way_id % 1000 < 300").join(
        w.nodes.withColumnRenamed("id", "node_id"), "node_id").select(
        F.col("way_id").alias("ring_id"), "pos", "lat", "lon")
    return spatial.points_in_rings(w.nodes, rings).select("id", "ring_id")


@query("radius_pairs", "O-34", f"""
SELECT p.id AS poi_id, n.id AS node_id, round({hav('p.lat','p.lon','n.lat','n.lon')},2) AS dist_m FROM {{fx_pois}} p JOIN {{fx_nodes}} n ON n.st BETWEEN p.st-1 AND p.st+1 AND abs(n.lat-p.lat)<0.0004e0
WHERE {hav('p.lat','p.lon','n.lat','n.lon')}<=30""")
def radius_pairs(w: World):
    left = w.view("fx_pois").select(F.col("id").alias("poi_id"), "lat", "lon")
    right = w.nodes.select(F.col("id").alias("node_id"), "lat", "lon")
    return spatial.radius_join(left, right, 30.0).select("poi_id", "node_id", F.round("dist_m", 2).alias("dist_m"))


@query("nearest_node", "O-35", f"""
SELECT p.id AS poi_id, n.id AS node_id, round({hav('p.lat','p.lon','n.lat','n.lon')},2) AS dist_m FROM {{fx_pois}} p JOIN {{fx_nodes}} n ON n.st BETWEEN p.st-1 AND p.st+1 AND abs(n.lat-p.lat)<0.0005e0
WHERE n.railway='stop' AND {hav('p.lat','p.lon','n.lat','n.lon')}<=40
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {hav('p.lat','p.lon','n.lat','n.lon')}, n.id)=1""")
def nearest_node(w: World):
    left = w.view("fx_pois").select(F.col("id").alias("poi_id"), "lat", "lon")
    right = w.nodes.where(tg.tag("tags", "railway") == "stop").select(F.col("id").alias("node_id"), "lat", "lon")
    return spatial.nearest(left, right, 40.0, tie="node_id").select("poi_id", "node_id", F.round("dist_m", 2).alias("dist_m"))


SHARED_VIEWS["o_direct"] = """
SELECT m.relation_id, avg(n.lat) AS lat, avg(n.lon) AS lon, count(*) AS n_members FROM {o_member} m JOIN {fx_nodes} n ON n.id=m.member_ref WHERE m.member_type='N' GROUP BY m.relation_id"""
SHARED_VIEWS["o_station"] = """
SELECT r.id AS relation_id, r.st, r.name, r.country, r.name_en, c.lat, c.lon, c.n_members FROM {fx_relations} r JOIN (SELECT * FROM {o_direct}
UNION ALL SELECT m.relation_id, avg(n.lat), avg(n.lon), count(*) FROM {o_member} m JOIN {fx_way_nodes} wn ON wn.way_id=m.member_ref JOIN {fx_nodes} n ON n.id=wn.node_id
  WHERE m.member_type='W' AND m.relation_id NOT IN (SELECT relation_id FROM {o_direct}) GROUP BY m.relation_id) c ON c.relation_id=r.id WHERE r.public_transport<>''"""


@query("station_centroids", "O-37", """
SELECT relation_id, name, nullif(country,'') AS country, round(lat,7) AS lat, round(lon,7) AS lon, n_members FROM {o_station}""")
def station_centroids(w: World):
    return stations(w).centres.withColumns({c: F.round(c, 7) for c in ("lat", "lon")})


@query("station_candidates", "O-36", f"""
WITH q AS (SELECT journey_id*10+leg_no AS query_id, st, arr_lat AS lat, arr_lon AS lon FROM {{fx_legs}} UNION ALL SELECT journey_id*10+leg_no, st, dep_lat, dep_lon FROM {{fx_legs}}),
d AS (SELECT q.query_id, s.relation_id, min({hav('q.lat','q.lon','s.lat','s.lon')}) AS dist FROM q JOIN {{o_station}} s ON s.st BETWEEN q.st-1 AND q.st+2 WHERE q.lat IS NOT NULL GROUP BY q.query_id, s.relation_id HAVING min({hav('q.lat','q.lon','s.lat','s.lon')})<=600)
SELECT query_id, relation_id, round(dist,1) AS dist_m, row_number() OVER (PARTITION BY query_id ORDER BY round(dist,3), relation_id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(dist,3), relation_id)<=6""")
def station_candidates(w: World):
    legs = w.view("fx_legs")
    key = (F.col("journey_id") * 10 + F.col("leg_no")).alias("query_id")
    points = legs.select(key, F.col("arr_lat").alias("lat"), F.col("arr_lon").alias("lon")).unionByName(
        legs.select(key, F.col("dep_lat").alias("lat"), F.col("dep_lon").alias("lon")))
    return spatial.station_candidates(points, stations(w).centres).select(
        "query_id", "relation_id", F.round("dist_m", 1).alias("dist_m"), F.col("rank").cast("long").alias("rank"))


SHARED_VIEWS["o_bridge"] = f"""
SELECT i.id AS node_a, v.node_id AS node_b, round(min({hav('n.lat','n.lon','m.lat','m.lon')}),2) AS dist_m, i.ring_id AS platform_way
FROM {{o_inside}} i JOIN {{fx_nodes}} n ON n.id=i.id JOIN {{fx_way_nodes}} v ON v.way_id=i.ring_id JOIN {{fx_nodes}} m ON m.id=v.node_id
WHERE i.id NOT IN (SELECT node_id FROM {{fx_way_nodes}} x WHERE x.way_id=i.ring_id) AND EXISTS(SELECT 1 FROM {{fx_way_nodes}} c JOIN {{o_way}} w ON w.way_id=c.way_id JOIN {{o_way}} a ON a.way_id=i.ring_id
  WHERE c.node_id=i.id AND (w.highway IN ('footway','steps','elevator') OR w.conveying<>'') AND (w.l0=a.l0 OR w.l1=a.l0))
GROUP BY i.id, v.node_id, i.ring_id QUALIFY row_number() OVER (PARTITION BY i.ring_id, i.id ORDER BY min({hav('n.lat','n.lon','m.lat','m.lon')}), v.node_id)=1"""


@query("stitch_bridges", "O-38", "SELECT * FROM {o_bridge}")
def stitch_bridges(w: World):
    return platforms.stitch_bridges(w.ways, w.nodes)


@query("coordinate_snap", "O-39", f"""
SELECT p.id AS poi_id, n.id AS anchor, min(wn.way_id) AS way_id, round({hav('p.lat','p.lon','n.lat','n.lon')},2) AS snap_m
FROM {{fx_pois}} p JOIN {{fx_nodes}} n ON n.st BETWEEN p.st-1 AND p.st+1 AND abs(n.lat-p.lat)<0.0005e0 AND abs(n.lon-p.lon)<0.0008e0 JOIN {{fx_way_nodes}} wn ON wn.node_id=n.id JOIN {{o_way}} w ON w.way_id=wn.way_id
WHERE (w.is_platform OR w.highway<>'') AND {hav('p.lat','p.lon','n.lat','n.lon')}<=40 GROUP BY p.id, n.id, p.lat, p.lon, n.lat, n.lon
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {hav('p.lat','p.lon','n.lat','n.lon')}, n.id)=1""")
def coordinate_snap(w: World):
    spots = w.view("fx_pois").select(F.col("id").alias("poi_id"), "lat", "lon")
    return platforms.snap_to_way(spots, w.ways, w.nodes, tg.is_pedestrian("tags")).select(
        "poi_id", "anchor", "way_id", F.round("snap_m", 2).alias("snap_m"))


@query("isolated_platforms", "O-40", "SELECT relation_id, ref FROM {o_lonely} WHERE relation_id%10=1 AND ref IN ('1','2','3','4')")
def isolated_platforms(w: World):
    st = stations(w)
    asked = w.relations.where(tg.tag("tags", "public_transport") == "stop_area").select(
        F.col("id").alias("relation_id"), F.explode(F.array(*[F.lit(r) for r in "1234"])).alias("ref"))
    hit = platforms.resolve_platforms(asked, st.footprint, w.ways).select(
        F.struct("relation_id", "ref").alias("platform"), "way_id")
    return platforms.isolated_platforms(hit, w.ways).select("platform.relation_id", "platform.ref")


@query("isolated_recovery", "O-41", """
SELECT relation_id, ref, node_id AS anchor, way_id, round(snap_m,2) AS snap_m FROM {o_saved} WHERE relation_id%10=1 AND ref IN ('1','2','3','4')""")
def isolated_recovery(w: World):
    st = stations(w)
    asked = w.relations.where(tg.tag("tags", "public_transport") == "stop_area").select(
        F.col("id").alias("relation_id"), F.explode(F.array(*[F.lit(r) for r in "1234"])).alias("ref"))
    hit = platforms.resolve_platforms(asked, st.footprint, w.ways).select(
        F.concat_ws("|", "relation_id", "ref").alias("platform"), "way_id")
    saved = platforms.recover_isolated(platforms.isolated_platforms(hit, w.ways), hit, w.ways, w.nodes)
    return saved.select(
        F.split_part("platform", F.lit("|"), F.lit(1)).cast("long").alias("relation_id"),
        F.split_part("platform", F.lit("|"), F.lit(2)).alias("ref"), "anchor", "way_id", F.round("snap_m", 2).alias("snap_m"))


@query("nearest_track_label", "O-42", f"""
SELECT p.id AS poi_id, n.ref AS label, round({hav('p.lat','p.lon','n.lat','n.lon')},2) AS label_m FROM {{fx_pois}} p JOIN {{fx_nodes}} n ON n.st BETWEEN p.st-1 AND p.st+1 AND abs(n.lat-p.lat)<0.0016e0
WHERE (n.railway='stop' OR n.public_transport='stop_position') AND n.ref<>'' AND {hav('p.lat','p.lon','n.lat','n.lon')}<=160
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {hav('p.lat','p.lon','n.lat','n.lon')}, n.id)=1""")
def nearest_track_label(w: World):
    spots = w.view("fx_pois").select(F.col("id").alias("poi_id"), "lat", "lon")
    return platforms.nearest_label(spots, way_ops.numeric_track_nodes(w.nodes)).select(
        "poi_id", "label", F.round("label_m", 2).alias("label_m"))


@query("nearest_quay", "O-43", f"""
SELECT p.id AS poi_id, q.public_label, q.step_free, q.has_lift, round({hav('p.lat','p.lon','q.lat','q.lon')},2) AS quay_m FROM {{fx_pois}} p JOIN {{fx_quays}} q ON q.st BETWEEN p.st-1 AND p.st+1
WHERE {hav('p.lat','p.lon','q.lat','q.lon')}<=160 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {hav('p.lat','p.lon','q.lat','q.lon')}, q.station_key||'|'||q.public_label)=1""")
def nearest_quay(w: World):
    spots = w.view("fx_pois").select(F.col("id").alias("poi_id"), "lat", "lon")
    return platforms.quay_at(spots, w.view("fx_quays")).select(
        "poi_id", "public_label", "step_free", "has_lift", F.round("quay_m", 2).alias("quay_m"))


SHARED_VIEWS["o_entry"] = "SELECT station, min(st) AS st, min(st_lat) AS lat, min(st_lon) AS lon, count(track) AS n_tracks FROM {fx_overlay} GROUP BY station"
SHARED_VIEWS["o_near_entry"] = f"""
SELECT s.relation_id AS query_id, e.station, e.lat, e.lon FROM {{o_station}} s JOIN {{o_entry}} e ON e.st BETWEEN s.st-1 AND s.st+1 WHERE {hav('s.lat','s.lon','e.lat','e.lon')}<=1500
QUALIFY row_number() OVER (PARTITION BY s.relation_id ORDER BY {hav('s.lat','s.lon','e.lat','e.lon')}, e.station)=1"""
SHARED_VIEWS["o_complex"] = f"""
SELECT a.query_id, e.station, e.n_tracks, {hav('a.lat','a.lon','e.lat','e.lon')} AS d FROM {{o_near_entry}} a JOIN {{o_entry}} e ON abs(e.lat-a.lat)<0.01e0 WHERE {hav('a.lat','a.lon','e.lat','e.lon')}<=300"""
SHARED_VIEWS["o_marker"] = """
SELECT c.query_id, o.track, o.lat AS t_lat, o.lon AS t_lon, n.station AS complex_name FROM {o_complex} c JOIN {fx_overlay} o ON o.station=c.station
JOIN (SELECT query_id, station FROM {o_complex} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_tracks DESC, d, station)=1) n ON n.query_id=c.query_id
QUALIFY row_number() OVER (PARTITION BY c.query_id, o.track ORDER BY c.d, c.station)=1"""


@query("complex_markers", "O-44", "SELECT query_id, complex_name, track, round(t_lat,6) AS t_lat, round(t_lon,6) AS t_lon FROM {o_marker}")
def complex_markers(w: World):
    queries = stations(w).centres.select(F.col("relation_id").alias("query_id"), "lat", "lon")
    return platforms.complex_markers(queries, w.view("fx_overlay")).withColumns(
        {c: F.round(c, 6) for c in ("t_lat", "t_lon")})


@query("anchor_coords", "O-110", """
SELECT r.id AS relation_id, CAST(k.n AS STRING) AS ref, round(m.t_lat,6) AS t_lat, round(m.t_lon,6) AS t_lon FROM {fx_relations} r CROSS JOIN (SELECT unnest([1,4,6,9]) AS n) k
LEFT JOIN {o_marker} m ON m.query_id=r.id AND m.track=CAST(k.n AS STRING) WHERE r.public_transport<>''""")
def anchor_coords(w: World):
    asked = w.relations.where(tg.tag("tags", "public_transport").isNotNull()).select(
        F.col("id").alias("relation_id"), F.explode(F.array(*[F.lit(r) for r in "1469"])).alias("ref"))
    return platforms.anchor_coords(asked, stations(w).centres, w.view("fx_overlay")).withColumns(
        {c: F.round(c, 6) for c in ("t_lat", "t_lon")})


@query("feed_merge", "O-45", f"""
WITH f AS (SELECT journey_id*10+leg_no AS seq, trim(arr_platform) AS code, arr_lat AS lat, arr_lon AS lon, st FROM {{fx_legs}} WHERE trim(arr_platform)<>''),
m AS (SELECT f.*, n.name AS station, n.lat AS nlat FROM f JOIN {{fx_nodes}} n ON n.railway='station' AND n.st BETWEEN f.st-1 AND f.st+1 AND {hav('f.lat','f.lon','n.lat','n.lon')}<=250
  QUALIFY row_number() OVER (PARTITION BY f.seq ORDER BY {hav('f.lat','f.lon','n.lat','n.lon')}, n.id)=1)
SELECT station, code, round(lat,6) AS lat, round(lon,6) AS lon, count(*) OVER (PARTITION BY station, code) AS n FROM m QUALIFY row_number() OVER (PARTITION BY station, code ORDER BY seq)=1""")
def feed_merge(w: World):
    feed = w.view("fx_legs").where("trim(arr_platform) <> ''").select(
        (F.col("journey_id") * 10 + F.col("leg_no")).alias("seq"), F.trim("arr_platform").alias("code"),
        F.col("arr_lat").alias("lat"), F.col("arr_lon").alias("lon"))
    return platforms.merge_feed(feed, way_ops.rail_stations(w.nodes)).select("station", "code", "lat", "lon", "n")


@query("harvested_tracks", "O-46", f"""
WITH o AS (SELECT arr_platform AS track, arr_lat AS lat, arr_lon AS lon, st FROM {{fx_legs}} WHERE mode<>'walking' AND arr_platform IS NOT NULL UNION ALL SELECT dep_platform, dep_lat, dep_lon, st FROM {{fx_legs}} WHERE mode<>'walking' AND dep_platform IS NOT NULL)
SELECT s.relation_id AS station, o.track, round(median(o.lat),6) AS lat, round(median(o.lon),6) AS lon, count(*) AS n FROM o JOIN {{o_station}} s ON s.st BETWEEN o.st-1 AND o.st+2 WHERE {hav('s.lat','s.lon','o.lat','o.lon')}<=700 GROUP BY s.relation_id, o.track""")
def harvested_tracks(w: World):
    legs = w.view("fx_legs").where("mode <> 'walking'")
    stops = legs.select(F.col("arr_platform").alias("track"), F.col("arr_lat").alias("lat"), F.col("arr_lon").alias("lon")).unionByName(
        legs.select(F.col("dep_platform").alias("track"), F.col("dep_lat").alias("lat"), F.col("dep_lon").alias("lon")))
    return platforms.harvest_labels(stops, stations(w).centres.select(F.col("relation_id").alias("station"), "lat", "lon"))


@query("harvest_candidates", "O-47", """
SELECT s.id AS station_id, s.name, count(DISTINCT w.way_id) AS total, count(DISTINCT CASE WHEN w.ref<>'' OR w.local_ref<>'' THEN w.way_id END) AS labelled,
  count(DISTINCT w.way_id)-count(DISTINCT CASE WHEN w.ref<>'' OR w.local_ref<>'' THEN w.way_id END) AS unlabelled
FROM {fx_nodes} s JOIN {fx_nodes} n ON n.lat BETWEEN s.lat-0.003e0 AND s.lat+0.003e0 AND n.lon BETWEEN s.lon-0.005e0 AND s.lon+0.005e0 JOIN {fx_way_nodes} wn ON wn.node_id=n.id JOIN {o_way} w ON w.way_id=wn.way_id
WHERE s.railway='station' AND w.is_platform GROUP BY s.id, s.name HAVING count(DISTINCT w.way_id)>count(DISTINCT CASE WHEN w.ref<>'' OR w.local_ref<>'' THEN w.way_id END)""")
def harvest_candidates(w: World):
    return platforms.harvest_candidates(way_ops.rail_stations(w.nodes), w.ways, w.nodes)


@query("platform_ladder", "O-48", "SELECT relation_id, ref, way_id, CAST(rung AS BIGINT) AS rung FROM {o_plat}")
def platform_ladder(w: World):
    asked = stations(w).boxes.select("relation_id", F.explode(F.array(*[F.lit(r) for r in ("1", "2", "3", "4", "5", "12", "99")])).alias("ref"))
    return platforms.resolve_platforms(asked, stations(w).footprint, w.ways).withColumn("rung", F.col("rung").cast("long"))


@query("stop_node_tier", "O-49", f"""
WITH s AS (SELECT b.relation_id, n.ref, n.lat, n.lon FROM {{o_box}} b JOIN {{fx_nodes}} n ON n.lat BETWEEN b.lat_lo AND b.lat_hi AND n.lon BETWEEN b.lon_lo AND b.lon_hi
  WHERE (railway='stop' OR public_transport='stop_position') AND ref IN ('6','7','12','19') AND NOT (bus='yes' AND railway<>'stop')
  QUALIFY row_number() OVER (PARTITION BY b.relation_id, n.ref ORDER BY {hav('(b.lat_lo+b.lat_hi)/2','(b.lon_lo+b.lon_hi)/2','n.lat','n.lon')}, n.id)=1)
SELECT s.relation_id, s.ref, n.id AS anchor, min(wn.way_id) AS way_id FROM s JOIN {{fx_nodes}} n ON abs(n.lat-s.lat)<0.0005e0 AND abs(n.lon-s.lon)<0.0008e0 JOIN {{fx_way_nodes}} wn ON wn.node_id=n.id JOIN {{o_way}} w ON w.way_id=wn.way_id
WHERE w.walkable AND {hav('s.lat','s.lon','n.lat','n.lon')}<=40 GROUP BY s.relation_id, s.ref, s.lat, s.lon, n.id, n.lat, n.lon
QUALIFY row_number() OVER (PARTITION BY s.relation_id, s.ref ORDER BY {hav('s.lat','s.lon','n.lat','n.lon')}, n.id)=1""")
def stop_node_tier(w: World):
    st = stations(w)
    asked = st.boxes.select("relation_id", F.explode(F.array(*[F.lit(r) for r in ("6", "7", "12", "19")])).alias("ref"))
    return platforms.resolve_by_stop(asked, st.boxes, st.stops, w.ways, w.nodes).select("relation_id", "ref", "anchor", "way_id")


@query("coordinate_tier", "O-50", f"""
WITH e AS (SELECT DISTINCT st, arr_platform AS ref, round(arr_lat,6) AS lat, round(arr_lon,6) AS lon FROM {{fx_legs}} WHERE arr_platform='98')
SELECT e.st, e.ref, e.lat, e.lon, n.id AS anchor, true AS by_coord FROM e JOIN {{fx_nodes}} n ON n.st BETWEEN e.st-1 AND e.st+1 AND abs(n.lat-e.lat)<0.0005e0 AND abs(n.lon-e.lon)<0.0008e0 JOIN {{o_touch}} t ON t.node_id=n.id AND t.ped
WHERE {hav('e.lat','e.lon','n.lat','n.lon')}<=40 QUALIFY row_number() OVER (PARTITION BY e.st, e.ref, e.lat, e.lon ORDER BY {hav('e.lat','e.lon','n.lat','n.lon')}, n.id)=1""")
def coordinate_tier(w: World):
    misses = w.view("fx_legs").where("arr_platform = '98'").select(
        "st", F.col("arr_platform").alias("ref"), F.round("arr_lat", 6).alias("lat"), F.round("arr_lon", 6).alias("lon")).distinct()
    return platforms.resolve_by_coord(misses, w.ways, w.nodes).select("st", "ref", "lat", "lon", "anchor", "by_coord")


@query("platform_refs", "O-51", """
SELECT relation_id, ref, row_number() OVER (PARTITION BY relation_id ORDER BY CAST(ref AS INT))-1 AS ord FROM {o_refs} WHERE ref<>''""")
def platform_refs(w: World):
    return stations(w).refs.withColumn("ord", F.col("ord").cast("long"))


@query("platform_centroids", "O-52", r"""
WITH c AS (SELECT wn.way_id, avg(n.lat) AS lat, avg(n.lon) AS lon FROM {fx_way_nodes} wn JOIN {fx_nodes} n ON n.id=wn.node_id GROUP BY wn.way_id),
t AS (SELECT DISTINCT f.relation_id, f.way_id, unnest(string_split_regex(w.ref||';'||w.local_ref, '\s*;\s*')) AS ref FROM {o_foot} f JOIN {o_way} w USING (way_id))
SELECT t.relation_id, t.ref, round(avg(c.lat),7) AS lat, round(avg(c.lon),7) AS lon FROM t JOIN c USING (way_id) WHERE t.ref<>'' GROUP BY t.relation_id, t.ref""")
def platform_centroids(w: World):
    return platforms.platform_centroids(stations(w).list_footprint, w.ways, w.nodes).withColumns(
        {c: F.round(c, 7) for c in ("lat", "lon")})


@query("track_labels", "O-53", """
SELECT journey_id, leg_no, coalesce(nullif(trim(regexp_replace(trim(dep_platform), '(?i)^(gl|gleis)\\s+', '')),''), nullif(trim(dep_platform),'')) AS dep_platform,
  coalesce(nullif(trim(regexp_replace(trim(arr_platform), '(?i)^(gl|gleis)\\s+', '')),''), nullif(trim(arr_platform),'')) AS arr_platform FROM {fx_legs}""".replace("\\\\", "\\"))
def track_labels(w: World):
    return platforms.normalise_tracks(w.view("fx_legs"), "dep_platform", "arr_platform").select(
        "journey_id", "leg_no", "dep_platform", "arr_platform")


@query("access_combined", "O-58", """
SELECT a.station_key, a.public_label AS arr_label, b.public_label AS dep_label, CASE WHEN a.step_free IS NULL OR b.step_free IS NULL THEN NULL ELSE a.step_free AND b.step_free END AS step_free,
  a.has_lift OR b.has_lift AS has_lift FROM {fx_quays} a JOIN {fx_quays} b ON a.station_key=b.station_key AND a.p<b.p""")
def access_combined(w: World):
    q = w.view("fx_quays")
    a = q.select("station_key", F.col("p").alias("a"), F.col("public_label").alias("arr_label"), F.col("step_free").alias("arr_step_free"), F.col("has_lift").alias("arr_has_lift"))
    b = q.select("station_key", F.col("p").alias("b"), F.col("public_label").alias("dep_label"), F.col("step_free").alias("dep_step_free"), F.col("has_lift").alias("dep_has_lift"))
    return platforms.combine_access(a.join(b, "station_key").where("a < b")).select("station_key", "arr_label", "dep_label", "step_free", "has_lift")


@query("station_platform_list", "O-92", """
WITH u AS (SELECT relation_id, ref FROM {o_refs} WHERE ref<>'' UNION SELECT query_id, track FROM {o_marker})
SELECT relation_id, ref, row_number() OVER (PARTITION BY relation_id ORDER BY CAST(ref AS INT))-1 AS ord FROM u""")
def station_platform_list(w: World):
    st = stations(w)
    markers = platforms.complex_markers(st.centres.select(F.col("relation_id").alias("query_id"), "lat", "lon"), w.view("fx_overlay"))
    return platforms.station_platforms(st.refs, markers).withColumn("ord", F.col("ord").cast("long"))
