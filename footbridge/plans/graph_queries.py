"""Registered queries over elements, ways and the walk graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from footbridge.functions import tags as tg
from footbridge.operators import elements, graph, platforms, walks, ways as way_ops
from footbridge.plans.registry import SHARED_VIEWS, hav, query
from footbridge.plans.stations import Stations, graph_edges, resolve_ends, walk_between
from footbridge.plans.world import World


def stations(w: World) -> Stations:
    return Stations(w.nodes, w.ways, w.members, w.relations)


# ---- shared check views ---------------------------------------------------------
SHARED_VIEWS["o_way"] = """
SELECT *, CASE WHEN level='0;1' THEN 0e0 WHEN level='1' THEN 1e0 ELSE 0e0 END AS l0,
  CASE WHEN level='' THEN 0e0 ELSE 1e0 END AS l1, CASE WHEN level='0;1' THEN 2 ELSE 1 END AS floors,
  CASE WHEN conveying<>'' THEN 0.9e0 WHEN highway='steps' THEN 0.5e0 ELSE 1.4e0 END AS speed,
  CASE WHEN conveying='' AND highway='elevator' THEN 30e0 ELSE 0e0 END AS penalty,
  CASE conveying WHEN 'forward' THEN 1 ELSE 0 END AS dir, highway='elevator' AS lift,
  public_transport<>'station' AS walkable,
  railway IN ('platform','platform_edge') AS is_platform
FROM {fx_ways}"""
SHARED_VIEWS["o_step"] = f"""
SELECT wn.way_id, wn.pos, wn.node_id, n.lat, n.lon, n.highway='elevator' AS mech,
  coalesce({hav('lag(n.lat) OVER q', 'lag(n.lon) OVER q', 'n.lat', 'n.lon')}, 0e0) AS step
FROM {{fx_way_nodes}} wn JOIN {{fx_nodes}} n ON n.id=wn.node_id
WINDOW q AS (PARTITION BY wn.way_id ORDER BY wn.pos)"""
SHARED_VIEWS["o_cum"] = """
SELECT *, sum(step) OVER (PARTITION BY way_id ORDER BY pos) AS cum,
  sum(step) OVER (PARTITION BY way_id) AS total, count(*) OVER (PARTITION BY way_id) AS present FROM {o_step}"""
SHARED_VIEWS["o_floor"] = """
SELECT c.*, w.speed, w.penalty, w.dir, w.lift, w.walkable, w.floors,
  CASE WHEN w.floors=1 OR present=1 THEN w.l0 ELSE w.l0+(w.l1-w.l0)*(cum/CASE WHEN total=0 THEN 1 ELSE total END) END AS floor
FROM {o_cum} c JOIN {o_way} w USING (way_id)"""
SHARED_VIEWS["o_vertex"] = """
SELECT *, CASE WHEN mech THEN arg_max(floor, pos) OVER (PARTITION BY way_id, node_id) ELSE -1e9 END AS lv
FROM {o_floor} WHERE walkable"""
SHARED_VIEWS["o_hop"] = """
SELECT way_id, pos, dir, lift, node_id AS a, lv AS a_lv, lead(node_id) OVER q AS b, lead(lv) OVER q AS b_lv,
  lead(step) OVER q AS metres, lead(step) OVER q/speed+penalty AS seconds
FROM {o_vertex} WINDOW q AS (PARTITION BY way_id ORDER BY pos)"""
SHARED_VIEWS["o_port"] = """
SELECT DISTINCT node_id, lv FROM {o_vertex} WHERE mech"""
SHARED_VIEWS["o_along"] = """
SELECT a AS src, a_lv AS src_lv, b AS dst, b_lv AS dst_lv, seconds, metres, lift, way_id FROM {o_hop} WHERE b IS NOT NULL AND dir>=0
UNION ALL SELECT b, b_lv, a, a_lv, seconds, metres, lift, way_id FROM {o_hop} WHERE b IS NOT NULL AND dir<=0"""
SHARED_VIEWS["o_edge"] = """
SELECT * FROM {o_along}
UNION ALL SELECT src, -1e9, dst, dst_lv, seconds, metres, lift, way_id FROM {o_along} WHERE src_lv<>-1e9
UNION ALL SELECT p.node_id, p.lv, q.node_id, q.lv, 30e0+abs(p.lv-q.lv)*4/1.4e0, 0e0, true, NULL
  FROM {o_port} p JOIN {o_port} q ON p.node_id=q.node_id AND p.lv<>q.lv"""


@query("entity_upsert", "O-01", """
SELECT user_id, event_id, event_type, value FROM {events}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1""")
def entity_upsert(w: World):
    rows = w.table("events").select("user_id", "event_id", "event_type", "value")
    return elements.load_entities(rows, "user_id", "event_id")


@query("member_flatten", "O-02", """
SELECT relation_id, row_number() OVER (PARTITION BY relation_id ORDER BY sequence)-1 AS sequence, member_type, member_ref, member_role
FROM {fx_members}""")
def member_flatten(w: World):
    nested = w.view("fx_members").groupBy(F.col("relation_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "sequence",
            F.when(F.col("member_type") == "W", "way").when(F.col("member_type") == "N", "node").otherwise("relation").alias("type"),
            F.col("member_ref").alias("ref"), F.col("member_role").alias("role")))).alias("members"))
    return elements.flatten_members(nested)


SCOPE = {"railway": ["platform", "platform_edge", "stop"], "conveying": None}


@query("tag_scope", "O-03", """
WITH kw AS (SELECT way_id FROM {fx_ways} WHERE railway IN ('platform','platform_edge','stop') OR conveying<>'')
SELECT 'node' AS element, id FROM {fx_nodes} WHERE railway='stop' OR id IN (SELECT node_id FROM {fx_way_nodes} JOIN kw USING (way_id))
UNION ALL SELECT 'way', way_id FROM kw""")
def tag_scope(w: World):
    nodes, ways = elements.scope_by_tags(w.nodes, w.ways, SCOPE)
    return nodes.select(F.lit("node").alias("element"), "id").unionByName(ways.select(F.lit("way").alias("element"), "id"))


@query("complete_ways_clip", "O-04", """
WITH inside AS (SELECT id FROM {fx_nodes} WHERE lon>8.00155e0 AND lon<8.00455e0 AND lat>47.0005e0 AND (lat<48.0005e0)),
kw AS (SELECT DISTINCT way_id FROM {fx_way_nodes} JOIN inside ON id=node_id)
SELECT 'node' AS element, id FROM {fx_nodes} WHERE id IN (SELECT id FROM inside) OR id IN (SELECT node_id FROM {fx_way_nodes} JOIN kw USING (way_id))
UNION ALL SELECT 'way', way_id FROM kw""")
def complete_ways_clip(w: World):
    ring = w.spark.sql("""SELECT 1 AS ring_id, pos, lat, lon FROM VALUES
        (0L, 47.0005D, 8.00155D), (1L, 47.0005D, 8.00455D), (2L, 48.0005D, 8.00455D), (3L, 48.0005D, 8.00155D) AS t(pos, lat, lon)""")
    nodes, ways = elements.clip_complete_ways(w.nodes, w.ways, ring)
    return nodes.select(F.lit("node").alias("element"), "id").unionByName(ways.select(F.lit("way").alias("element"), "id"))


@query("resume_anti_join", "O-14", """
SELECT id AS relation_id FROM {fx_relations} WHERE id NOT IN (SELECT DISTINCT relation_id FROM {fx_members} WHERE member_type='N')""")
def resume_anti_join(w: World):
    universe = w.relations.select(F.col("id").alias("relation_id"))
    return elements.still_to_do(universe, w.members.where("member_type = 'N'"), "relation_id")


@query("walkable_ways", "O-18", "SELECT way_id FROM {fx_ways} WHERE public_transport<>'station'")
def walkable_ways(w: World):
    return way_ops.walkable(w.ways).select(F.col("id").alias("way_id"))


@query("way_classes", "O-19", """
SELECT way_id, railway='platform_edge' AS is_edge, railway='platform' AS is_area_platform,
  railway IN ('platform','platform_edge') AS is_platform,
  railway IN ('platform','platform_edge') OR highway IN ('footway','steps','elevator') AS is_pedestrian,
  highway IN ('footway','steps','elevator') OR conveying<>'' AS is_connector, public_transport<>'station' AS is_walkable
FROM {fx_ways}""")
def way_classes(w: World):
    return way_ops.classify_ways(w.ways).drop("nodes", "tags").withColumnRenamed("id", "way_id")


@query("rail_stops", "O-20", """
SELECT id AS node_id, ref, round(lat,6) AS lat, round(lon,6) AS lon FROM {fx_nodes}
WHERE (railway='stop' OR public_transport='stop_position') AND ref<>'' AND NOT (bus='yes' AND railway<>'stop')""")
def rail_stops(w: World):
    return way_ops.station_stops(w.nodes).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query("rail_platform_filter", "O-21", "SELECT way_id FROM {fx_ways} WHERE railway IN ('platform','platform_edge') AND tram='' AND highway=''")
def rail_platform_filter(w: World):
    return way_ops.rail_platforms(w.ways).select(F.col("id").alias("way_id"))


@query("kind_labels", "O-22", """
SELECT way_id, CASE WHEN conveying<>'' THEN 'escalator' WHEN highway='elevator' THEN 'elevator' WHEN highway='steps' THEN 'stairs'
  WHEN railway IN ('platform','platform_edge') THEN 'platform' WHEN highway='footway' AND level='0;1' THEN 'ramp' WHEN highway='footway' THEN 'walkway' ELSE 'other' END AS kind,
  level='0;1' OR highway IN ('steps','elevator') OR conveying<>'' AS connector, area='yes' OR public_transport='station' AS area
FROM {fx_ways}""")
def kind_labels(w: World):
    return way_ops.label_kinds(w.ways)


@query("node_kinds", "O-22", "SELECT id AS node_id, CASE WHEN highway='elevator' THEN 'elevator' ELSE 'vertical' END AS kind FROM {fx_nodes}")
def node_kinds(w: World):
    return way_ops.label_node_kinds(w.nodes)


@query("member_reload", "O-02", """
SELECT * FROM {fx_members} WHERE relation_id NOT IN (SELECT id FROM {fx_relations} WHERE country='CH')
UNION ALL SELECT m.relation_id, m.sequence, m.member_type, m.member_ref, 'again' FROM {fx_members} m JOIN {fx_relations} r ON r.id=m.relation_id WHERE r.country='CH' AND m.member_type='W'""")
def member_reload(w: World):
    again = w.relations.where(tg.tag("tags", "country") == "CH").select(F.col("id").alias("relation_id"))
    incoming = w.members.where("member_type = 'W'").join(again, "relation_id", "left_semi").withColumn("member_role", F.lit("again"))
    return elements.replace_members(w.members, incoming)


@query("station_name_lookup", "O-23", """
SELECT id AS relation_id, name FROM {fx_relations} WHERE public_transport IN ('stop_area','stop_area_group')
AND name IN (SELECT 'Halt '||CAST(n_nationkey AS STRING) FROM {nation})""")
def station_name_lookup(w: World):
    names = w.table("nation").select(F.concat(F.lit("Halt "), F.col("n_nationkey").cast("string")).alias("name"))
    return elements.stations_named(w.relations, names).select("relation_id", "name")


@query("node_way_index", "O-24", """
SELECT node_id, string_agg(CAST(way_id AS STRING), ',' ORDER BY way_id) AS way_ids FROM (SELECT DISTINCT node_id, way_id FROM {fx_way_nodes}) t GROUP BY node_id""")
def node_way_index(w: World):
    return graph.node_way_ids(w.ways).select("node_id", F.array_join(F.transform("way_ids", lambda x: x.cast("string")), ",").alias("way_ids"))


@query("way_segments", "O-25", """
SELECT way_id, node_id AS node_from, node_to FROM (SELECT way_id, node_id, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS node_to FROM {fx_way_nodes}) t WHERE node_to IS NOT NULL""")
def way_segments(w: World):
    return graph.way_segments(w.ways).select("way_id", "node_from", "node_to")


@query("multipolygon_tags", "O-26", """
WITH src AS (SELECT m.member_ref AS way_id, r.highway, r.level FROM {fx_members} m JOIN {fx_relations} r ON r.id=m.relation_id JOIN {fx_ways} w ON w.way_id=m.member_ref
  WHERE m.member_type='W' AND r.type='multipolygon' AND w.railway='' AND w.highway='' AND w.conveying='' AND w.ref='' AND w.level='' AND w.public_transport=''
  QUALIFY row_number() OVER (PARTITION BY m.member_ref ORDER BY r.id)=1)
SELECT w.way_id, nullif(coalesce(s.highway, w.highway),'') AS highway, nullif(coalesce(s.level, w.level),'') AS level, s.way_id IS NOT NULL AS touched
FROM {fx_ways} w LEFT JOIN src s USING (way_id)""")
def multipolygon_tags(w: World):
    updated, touched = elements.propagate_tags(w.ways, w.members, w.relations)
    mark = touched.withColumn("touched", F.lit(True))
    return updated.withColumnRenamed("id", "way_id").join(mark, "way_id", "left").select(
        "way_id", tg.tag("tags", "highway").alias("highway"), tg.tag("tags", "level").alias("level"),
        F.coalesce("touched", F.lit(False)).alias("touched"))


@query("multipolygon_revert", "O-26", "SELECT way_id, nullif(highway,'') AS highway, nullif(level,'') AS level FROM {fx_ways}")
def multipolygon_revert(w: World):
    updated, touched = elements.propagate_tags(w.ways, w.members, w.relations)
    return elements.revert_tags(updated, touched).select(
        F.col("id").alias("way_id"), tg.tag("tags", "highway").alias("highway"), tg.tag("tags", "level").alias("level"))


@query("relation_members_closure", "O-27", """
WITH up AS (SELECT relation_id AS root, relation_id AS cur FROM {fx_members} UNION SELECT up.root, m.member_ref FROM up JOIN {fx_members} m ON m.relation_id=up.cur AND m.member_type='R')
SELECT DISTINCT root AS relation_id, m.member_type, m.member_ref FROM up JOIN {fx_members} m ON m.relation_id=up.cur WHERE m.member_type<>'R'""")
def relation_members_closure(w: World):
    return graph.relation_closure(w.members)


@query("walk_edges", "O-28, O-30", """
SELECT src, round(src_lv,6) AS src_lv, dst, round(dst_lv,6) AS dst_lv, round(seconds,4) AS seconds, round(metres,4) AS metres, lift FROM {o_edge}""")
def walk_edges(w: World):
    return graph.walk_edges(w.ways, w.nodes).select(
        "src", F.round("src_lv", 6).alias("src_lv"), "dst", F.round("dst_lv", 6).alias("dst_lv"),
        F.round("seconds", 4).alias("seconds"), F.round("metres", 4).alias("metres"), "lift")


@query("way_levels", "O-29", "SELECT way_id, node_id, round(arg_max(floor, pos),6) AS level FROM {o_floor} GROUP BY way_id, node_id")
def way_levels(w: World):
    return graph.way_node_levels(w.ways, w.nodes).withColumn("level", F.round("level", 6))


@query("vertical_edges", "O-30", """
SELECT p.node_id, round(p.lv,6) AS from_level, round(q.lv,6) AS to_level, round(30e0+abs(p.lv-q.lv)*4/1.4e0,4) AS seconds
FROM {o_port} p JOIN {o_port} q ON p.node_id=q.node_id AND p.lv<>q.lv""")
def vertical_edges(w: World):
    ports = graph.node_ports(w.ways, w.nodes)
    return graph.vertical_edges(ports).select(
        F.col("src").alias("node_id"), F.round("src_lv", 6).alias("from_level"), F.round("dst_lv", 6).alias("to_level"),
        F.round("seconds", 4).alias("seconds"))


SHARED_VIEWS["o_reach"] = """
SELECT st*10+1 AS relation_id, st*10+1 AS cur FROM {plat} WHERE p=0 UNION ALL SELECT st*10+2, st*10+1 FROM {plat} WHERE p=0"""
SHARED_VIEWS["o_member"] = """
SELECT DISTINCT r.relation_id, m.member_type, m.member_ref FROM {o_reach} r JOIN {fx_members} m ON m.relation_id=r.cur WHERE m.member_type<>'R'"""
SHARED_VIEWS["o_seed"] = """
SELECT relation_id, member_ref AS node_id FROM {o_member} WHERE member_type='N'
UNION SELECT m.relation_id, wn.node_id FROM {o_member} m JOIN {fx_way_nodes} wn ON wn.way_id=m.member_ref JOIN {o_way} w ON w.way_id=wn.way_id WHERE m.member_type='W' AND w.walkable"""
SHARED_VIEWS["o_box"] = """
SELECT relation_id, min(lat)-600/111320e0 AS lat_lo, max(lat)+600/111320e0 AS lat_hi,
  min(lon)-600/(111320e0*greatest(0.1e0,cos(radians(avg(lat))))) AS lon_lo, max(lon)+600/(111320e0*greatest(0.1e0,cos(radians(avg(lat))))) AS lon_hi
FROM {o_seed} s JOIN {fx_nodes} n ON n.id=s.node_id GROUP BY relation_id"""
SHARED_VIEWS["o_foot"] = """
SELECT DISTINCT b.relation_id, wn.way_id FROM {o_box} b JOIN {fx_nodes} n ON n.lat BETWEEN lat_lo AND lat_hi AND n.lon BETWEEN lon_lo AND lon_hi
JOIN {fx_way_nodes} wn ON wn.node_id=n.id JOIN {o_way} w ON w.way_id=wn.way_id WHERE w.is_platform"""


@query("station_footprints", "O-31", "SELECT relation_id, way_id FROM {o_foot}")
def station_footprints(w: World):
    return stations(w).footprint


@query("walkable_closure", "O-32", """
WITH box AS (SELECT relation_id, min(lat)-1000/111320e0 AS lat_lo, max(lat)+1000/111320e0 AS lat_hi,
  min(lon)-1000/(111320e0*greatest(0.1e0,cos(radians(avg(lat))))) AS lon_lo, max(lon)+1000/(111320e0*greatest(0.1e0,cos(radians(avg(lat))))) AS lon_hi
  FROM {o_seed} s JOIN {fx_nodes} n ON n.id=s.node_id GROUP BY relation_id),
nw AS (SELECT DISTINCT n.id AS node_id, n.lat, n.lon, wn.way_id FROM {fx_nodes} n JOIN {fx_way_nodes} wn ON wn.node_id=n.id JOIN {o_way} w ON w.way_id=wn.way_id WHERE w.walkable),
r(relation_id, node_id, way_id) AS (SELECT relation_id, node_id, CAST(0 AS BIGINT) FROM {o_seed}
  UNION SELECT r.relation_id, nw2.node_id, nw.way_id FROM r JOIN box b USING (relation_id) JOIN nw ON nw.node_id=r.node_id AND nw.lat BETWEEN b.lat_lo AND b.lat_hi AND nw.lon BETWEEN b.lon_lo AND b.lon_hi JOIN nw nw2 ON nw2.way_id=nw.way_id)
SELECT DISTINCT relation_id, way_id FROM r WHERE way_id>0 OR (way_id=0 AND relation_id IN (SELECT 0))
UNION SELECT m.relation_id, m.member_ref FROM {o_member} m JOIN {o_way} w ON w.way_id=m.member_ref WHERE m.member_type='W' AND w.walkable""")
def walkable_closure(w: World):
    st = stations(w)
    seeds = graph.seed_nodes(st.station_closure, w.ways, True)
    boxes = graph.station_boxes(st.station_closure, w.nodes, w.ways, 1000.0)
    walkable = w.ways.where(tg.is_walkable("tags")).select(F.col("id").alias("member_ref"))
    own = st.station_closure.where("member_type = 'W'").join(walkable, "member_ref", "left_semi").select(
        "relation_id", F.col("member_ref").alias("way_id"))
    return graph.walkable_closure(seeds, w.ways, w.nodes, boxes, seed_ways=own).select("relation_id", "way_id")


# ---- walks ------------------------------------------------------------------------
SHARED_VIEWS["o_tier"] = r"""
SELECT f.relation_id, q.ref, f.way_id, CASE
  WHEN w.railway='platform_edge' AND w.ref=q.ref THEN 1 WHEN w.railway='platform_edge' AND w.track_ref LIKE '%'||lpad(q.ref, greatest(2, CAST(length(q.ref) AS INT)), '0')||'%' THEN 2
  WHEN w.railway='platform' AND w.ref=q.ref THEN 3 WHEN w.railway='platform' AND w.local_ref=q.ref THEN 4
  WHEN list_contains(string_split_regex(w.ref, '\s*;\s*'), q.ref) THEN 5 WHEN list_contains(string_split_regex(w.local_ref, '\s*;\s*'), q.ref) THEN 6 END AS rung
FROM {o_foot} f JOIN {o_way} w ON w.way_id=f.way_id CROSS JOIN (SELECT '1' AS ref UNION ALL SELECT '2' UNION ALL SELECT '3' UNION ALL SELECT '4' UNION ALL SELECT '5' UNION ALL SELECT '12' UNION ALL SELECT '99') q"""
SHARED_VIEWS["o_plat"] = """
SELECT relation_id, ref, way_id, rung FROM {o_tier} WHERE rung IS NOT NULL QUALIFY rung=min(rung) OVER (PARTITION BY relation_id, ref)"""
SHARED_VIEWS["o_own"] = """
SELECT DISTINCT p.relation_id, p.ref, wn.node_id FROM {o_plat} p JOIN {fx_way_nodes} wn ON wn.way_id=p.way_id"""
# the isolated platform 4 of every st%6=2 station is joined to row 14 beside the polygon's low corner
SHARED_VIEWS["o_lonely"] = """
SELECT p.relation_id, p.ref FROM {o_plat} p GROUP BY p.relation_id, p.ref HAVING NOT bool_or(EXISTS(
  SELECT 1 FROM {fx_way_nodes} a JOIN {fx_way_nodes} b ON a.node_id=b.node_id JOIN {o_way} w ON w.way_id=b.way_id
  WHERE a.way_id=p.way_id AND w.walkable AND b.way_id NOT IN (SELECT q.way_id FROM {o_plat} q WHERE q.relation_id=p.relation_id AND q.ref=p.ref)))"""
SHARED_VIEWS["o_touch"] = """
SELECT DISTINCT wn.node_id, wn.way_id, w.is_platform OR w.highway<>'' AS ped FROM {fx_way_nodes} wn JOIN {o_way} w USING (way_id) WHERE w.walkable"""
SHARED_VIEWS["o_leads"] = """
SELECT DISTINCT a.way_id FROM {o_touch} a JOIN {o_touch} b ON a.node_id=b.node_id AND a.way_id<>b.way_id"""
SHARED_VIEWS["o_saved"] = f"""
SELECT l.relation_id, l.ref, n.id AS node_id, f.way_id, min({hav('n.lat','n.lon','m.lat','m.lon')}) AS snap_m
FROM {{o_lonely}} l JOIN {{o_own}} o ON o.relation_id=l.relation_id AND o.ref=l.ref JOIN {{fx_nodes}} m ON m.id=o.node_id
JOIN {{fx_nodes}} n ON n.st=m.st AND abs(n.lat-m.lat)<0.0005e0 AND abs(n.lon-m.lon)<0.0008e0
JOIN {{o_floor}} f ON f.node_id=n.id JOIN {{o_touch}} t ON t.node_id=n.id AND t.way_id=f.way_id AND t.ped
JOIN {{o_leads}} k ON k.way_id=f.way_id
WHERE {hav('n.lat','n.lon','m.lat','m.lon')}<=40 AND abs(f.floor-1)<=0.5 AND NOT EXISTS(SELECT 1 FROM {{o_own}} x WHERE x.relation_id=l.relation_id AND x.ref=l.ref AND x.node_id=n.id)
  AND f.way_id NOT IN (SELECT way_id FROM {{o_plat}} x WHERE x.relation_id=l.relation_id AND x.ref=l.ref)
GROUP BY l.relation_id, l.ref, n.id, f.way_id QUALIFY row_number() OVER (PARTITION BY l.relation_id, l.ref ORDER BY min({hav('n.lat','n.lon','m.lat','m.lon')}), n.id, f.way_id)=1"""
SHARED_VIEWS["o_anchor"] = """
SELECT o.relation_id, o.ref, o.node_id, false AS by_coord FROM {o_own} o WHERE NOT EXISTS(SELECT 1 FROM {o_saved} s WHERE s.relation_id=o.relation_id AND s.ref=o.ref)
UNION ALL SELECT relation_id, ref, node_id, true FROM {o_saved}"""


def search_view(edges: str = "{o_edge}", starts: str = "SELECT DISTINCT relation_id, ref, node_id, 0e0 AS s FROM {o_anchor}") -> str:
    return f"""o_sp(relation_id, ref, node, lv, seconds, metres) USING KEY (relation_id, ref, node, lv) AS (
SELECT relation_id, ref, node_id, -1e9, s, s*1.4e0 FROM ({starts}) z
UNION
SELECT p.relation_id, p.ref, e.dst, e.dst_lv, min(p.seconds+e.seconds), arg_min(p.metres+e.metres, p.seconds+e.seconds)
FROM o_sp p JOIN {edges} e ON e.src=p.node AND e.src_lv=p.lv
LEFT JOIN recurring.o_sp r ON r.relation_id=p.relation_id AND r.ref=p.ref AND r.node=e.dst AND r.lv=e.dst_lv
WHERE p.seconds+e.seconds<coalesce(r.seconds, 1e18)-1e-9
GROUP BY p.relation_id, p.ref, e.dst, e.dst_lv)"""


SHARED_VIEWS["o_sp"] = search_view()
SHARED_VIEWS["o_walk"] = """
SELECT s.relation_id, s.ref AS from_ref, a.ref AS to_ref, round(min(s.seconds),1) AS seconds, round(arg_min(s.metres, s.seconds),1) AS metres
FROM {o_sp} s JOIN {o_anchor} a ON a.relation_id=s.relation_id AND a.node_id=s.node AND s.lv=-1e9 WHERE s.ref<>a.ref GROUP BY ALL"""


@query("walk_one_to_three", "O-54 (flagship)", """
SELECT r.id AS relation_id, w.seconds IS NOT NULL AS found, w.seconds, w.metres, CASE WHEN w.seconds IS NULL THEN 'disconnected' END AS reason
FROM {fx_relations} r LEFT JOIN {o_walk} w ON w.relation_id=r.id AND w.from_ref='1' AND w.to_ref='3' WHERE r.public_transport='stop_area'""")
def walk_one_to_three(w: World):
    asked = w.relations.where(tg.tag("tags", "public_transport") == "stop_area").select(
        F.col("id").alias("request_id"), F.col("id").alias("relation_id"), F.lit("1").alias("from_ref"), F.lit("3").alias("to_ref"))
    out = walk_between(stations(w), asked)
    return out.select("relation_id", "found", F.round("seconds", 1).alias("seconds"), F.round("metres", 1).alias("metres"), "reason")


def all_pairs(st: Stations, relations, both_ways: bool = True):
    """Every pair of a stop area's refs. The listed refs of one station are a few dozen."""
    own = relations.where(tg.tag("tags", "public_transport") == "stop_area").select(F.col("id").alias("relation_id"))
    refs = st.refs.join(own, "relation_id", "left_semi")
    a = refs.select("relation_id", F.col("ref").alias("from_ref"), F.col("ord").alias("a"))
    b = refs.select("relation_id", F.col("ref").alias("to_ref"), F.col("ord").alias("b"))
    pairs = a.join(b, "relation_id").where("a <> b" if both_ways else "a < b")
    return pairs.select(F.concat_ws("|", "relation_id", "from_ref", "to_ref").alias("request_id"), "relation_id", "from_ref", "to_ref")


SHARED_VIEWS["o_refs"] = r"""
SELECT DISTINCT f.relation_id, unnest(string_split_regex(w.ref||';'||w.local_ref, '\s*;\s*')) AS ref FROM {o_foot} f JOIN {o_way} w USING (way_id)"""
SHARED_VIEWS["o_ask"] = """
SELECT a.relation_id, a.ref AS from_ref, b.ref AS to_ref FROM {o_refs} a JOIN {o_refs} b USING (relation_id) WHERE a.ref<>b.ref AND a.ref<>'' AND b.ref<>'' AND a.relation_id%10=1"""


@query("shortest_walks", "O-54", """
SELECT q.*, w.seconds IS NOT NULL AS found, w.seconds, w.metres, CASE WHEN w.seconds IS NULL THEN 'disconnected' END AS reason
FROM {o_ask} q LEFT JOIN {o_walk} w USING (relation_id, from_ref, to_ref)""")
def shortest_walks(w: World):
    st = stations(w)
    out = walk_between(st, all_pairs(st, w.relations))
    return out.select("relation_id", "from_ref", "to_ref", "found", F.round("seconds", 1).alias("seconds"),
                      F.round("metres", 1).alias("metres"), "reason")
