"""Registered queries over the vertical shape of walks, path cross-checks and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.operators import graph, heights, linkage, platforms, walks
from footbridge.plans.graph_queries import all_pairs, stations
from footbridge.plans.registry import SHARED_VIEWS, hav, query
from footbridge.plans.stations import graph_edges, resolve_ends, walk_between
from footbridge.plans.world import World
from footbridge.session import cut

SHARED_VIEWS["o_pathpt"] = "SELECT p.path_id, p.seq, p.node_id, n.lat, n.lon FROM {fx_path} p JOIN {fx_nodes} n ON n.id=p.node_id"
SHARED_VIEWS["o_origin"] = "SELECT path_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM {o_pathpt} GROUP BY path_id"


def path_points(w: World):
    return w.view("fx_path").join(w.nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")


@query("local_projection", "O-93", """
SELECT p.path_id, round(min((lon-lon0)*111320e0*cos(radians(lat0))),2) AS min_x, round(max((lon-lon0)*111320e0*cos(radians(lat0))),2) AS max_x, round(min((lat-lat0)*111320e0),2) AS min_y, round(max((lat-lat0)*111320e0),2) AS max_y
FROM {o_pathpt} p JOIN {o_origin} o USING (path_id) GROUP BY p.path_id""")
def local_projection(w: World):
    pts = path_points(w).withColumn("level", F.lit(0.0))
    out = heights.extent(heights.project(pts, heights.origins(pts, "path_id"), "path_id"), "path_id")
    return out.select("path_id", *[F.round(c, 2).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


SHARED_VIEWS["o_hstep"] = """
SELECT wn.way_id, wn.pos, wn.node_id, n.lat, n.lon, nullif(n.level,'') AS own, avg(n.lat) OVER (PARTITION BY wn.way_id) AS lat0 FROM {fx_way_nodes} wn JOIN {fx_nodes} n ON n.id=wn.node_id"""
SHARED_VIEWS["o_hcum"] = """
SELECT *, coalesce(sqrt(pow((lon-lag(lon) OVER q)*111320e0*cos(radians(lat0)),2)+pow((lat-lag(lat) OVER q)*111320e0,2)),0) AS step, first_value(own) OVER r AS own0, last_value(own) OVER r AS own1 FROM {o_hstep}
WINDOW q AS (PARTITION BY way_id ORDER BY pos), r AS (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
SHARED_VIEWS["o_hsum"] = "SELECT *, sum(step) OVER (PARTITION BY way_id ORDER BY pos) AS cum, sum(step) OVER (PARTITION BY way_id) AS total FROM {o_hcum}"
SHARED_VIEWS["o_z"] = """
SELECT s.way_id, s.node_id, 4e0*arg_max(CASE WHEN w.floors=1 THEN w.l0 ELSE coalesce(CAST(own0 AS DOUBLE),w.l0)+(coalesce(CAST(own1 AS DOUBLE),w.l1)-coalesce(CAST(own0 AS DOUBLE),w.l0))*cum/total END, s.pos) AS z FROM {o_hsum} s JOIN {o_way} w USING (way_id) GROUP BY s.way_id, s.node_id"""


@query("node_heights", "O-94", "SELECT way_id, node_id, round(z,3) AS z FROM {o_z}")
def node_heights(w: World):
    return heights.node_heights(w.ways, w.nodes).withColumn("z", F.round("z", 3))


SHARED_VIEWS["o_phop"] = "SELECT path_id, seq, node_id AS a, lead(node_id) OVER (PARTITION BY path_id ORDER BY seq) AS b FROM {fx_path}"
SHARED_VIEWS["o_seg2"] = "SELECT way_id, node_id AS a, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM {fx_way_nodes}"
SHARED_VIEWS["o_legal"] = """
SELECT s.way_id, s.a, s.b, w.level<>'' AS hl, w.highway<>'' OR w.railway<>'' AS hp FROM {o_seg2} s JOIN {o_way} w USING (way_id) WHERE s.b IS NOT NULL AND w.dir>=0 UNION ALL SELECT s.way_id, s.b, s.a, w.level<>'', w.highway<>'' OR w.railway<>'' FROM {o_seg2} s JOIN {o_way} w USING (way_id) WHERE s.b IS NOT NULL AND w.dir<=0"""
SHARED_VIEWS["o_hopway"] = """
SELECT h.path_id, h.seq, h.a, h.b, l.way_id FROM {o_phop} h LEFT JOIN {o_legal} l ON l.a=h.a AND l.b=h.b WHERE h.b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h.path_id, h.seq ORDER BY l.hl DESC, l.hp DESC, l.way_id)=1"""


def hops(w: World):
    return heights.hop_ways(heights.path_steps(w.view("fx_path")), w.ways)


@query("hop_ways", "O-95", "SELECT path_id, seq, a, b, way_id FROM {o_hopway}")
def hop_ways(w: World):
    return hops(w)


SHARED_VIEWS["o_hz"] = """
SELECT h.*, coalesce(x.z, (SELECT arg_min(z, way_id) FROM {o_z} g WHERE g.node_id=h.a), 0) AS za, coalesce(y.z, (SELECT arg_min(z, way_id) FROM {o_z} g WHERE g.node_id=h.b), 0) AS zb FROM {o_hopway} h
LEFT JOIN {o_z} x ON x.way_id=h.way_id AND x.node_id=h.a LEFT JOIN {o_z} y ON y.way_id=h.way_id AND y.node_id=h.b"""
SHARED_VIEWS["o_kind"] = """
SELECT way_id, CASE WHEN conveying<>'' THEN 'escalator' WHEN highway='elevator' THEN 'elevator' WHEN highway='steps' THEN 'stairs' WHEN railway<>'' THEN 'platform' WHEN highway='footway' AND level='0;1' THEN 'ramp' WHEN highway='footway' THEN 'walkway' ELSE 'other' END AS kind FROM {fx_ways}"""
SHARED_VIEWS["o_trans"] = """
SELECT z.path_id, z.seq, 'node' AS change_at, CASE WHEN n.highway='elevator' THEN 'elevator' ELSE 'vertical' END AS kind, before AS from_z, za AS to_z, z.a AS node_id FROM (SELECT *, lag(zb) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM {o_hz}) z JOIN {fx_nodes} n ON n.id=z.a WHERE abs(before-za)>0.01
UNION ALL SELECT z.path_id, z.seq, CASE WHEN z.way_id IS NULL THEN 'stitch' ELSE 'way' END, CASE WHEN z.way_id IS NULL THEN 'stitch' ELSE k.kind END, za, zb, CASE WHEN z.way_id IS NULL THEN z.a END FROM {o_hz} z LEFT JOIN {o_kind} k USING (way_id) WHERE z.way_id IS NULL OR abs(za-zb)>0.01"""


def moves(w: World):
    # both are read several times below, so they are written once
    return heights.transitions(cut(hops(w)), cut(heights.node_heights(w.ways, w.nodes)), w.ways, w.nodes)


@query("level_transitions", "O-96", "SELECT path_id, seq, change_at, kind, round(from_z,2) AS from_z, round(to_z,2) AS to_z FROM {o_trans}")
def level_transitions(w: World):
    return moves(w).select("path_id", "seq", F.col("at").alias("change_at"), "kind", F.round("from_z", 2).alias("from_z"), F.round("to_z", 2).alias("to_z"))


# plane coordinates of a segment's ends as seen from a point, where on it the nearest spot lies, and the squared distance
ENDS = ", ".join(f'({s}.lon-{{p}}.lon)*111320e0*cos(radians({{p}}.lat)) AS {s}x, ({s}.lat-{{p}}.lat)*111320e0 AS "{s}y"' for s in "ab")
CLAMP = 'CASE WHEN bx=ax AND "by"=ay THEN 0e0 ELSE greatest(0e0, least(1e0, -(ax*(bx-ax)+ay*("by"-ay))/(pow(bx-ax,2)+pow("by"-ay,2)))) END AS t'
DIST2 = 'pow(ax+t*(bx-ax),2)+pow(ay+t*("by"-ay),2)'


@query("attributed_transitions", "O-97", f"""
WITH o AS (SELECT t.path_id, t.seq, t.node_id, least(from_z,to_z) AS zl, greatest(from_z,to_z) AS zh, n.lat, n.lon, n.st FROM {{o_trans}} t JOIN {{fx_nodes}} n ON n.id=t.node_id WHERE t.change_at='node' AND t.kind='vertical'),
l AS (SELECT k.way_id, k.kind, w.st, 4*w.l0 AS lo, 4*w.l1 AS hi FROM {{o_kind}} k JOIN {{o_way}} w USING (way_id) WHERE k.kind IN ('escalator','stairs','elevator')),
c AS (SELECT o.path_id, o.seq, o.node_id, o.zl, o.zh, l.way_id, l.kind, l.lo, l.hi, {ENDS.format(p='o')} FROM o JOIN l ON l.st=o.st JOIN {{o_seg2}} s ON s.way_id=l.way_id AND s.b IS NOT NULL JOIN {{fx_nodes}} a ON a.id=s.a JOIN {{fx_nodes}} b ON b.id=s.b),
d AS (SELECT path_id, seq, node_id, zl, zh, way_id, kind, lo, hi, min({DIST2}) AS d2 FROM (SELECT *, {CLAMP} FROM c) c2 GROUP BY path_id, seq, node_id, zl, zh, way_id, kind, lo, hi),
e AS (SELECT d.*, lo<=zl+0.6 AND hi>=zh-0.6 AS spans, x.node_id IS NOT NULL AND hi>=zl-0.6 AND lo<=zh+0.6 AS laps FROM d LEFT JOIN (SELECT DISTINCT way_id, node_id FROM {{fx_way_nodes}}) x ON x.way_id=d.way_id AND x.node_id=d.node_id),
g AS (SELECT *, (spans OR laps) AND d2<=64 AS close FROM e),
f AS (SELECT path_id, seq, kind FROM g WHERE close OR (spans AND d2<=144) QUALIFY row_number() OVER (PARTITION BY path_id, seq ORDER BY close DESC, d2, CASE kind WHEN 'escalator' THEN 0 WHEN 'stairs' THEN 1 ELSE 2 END)=1)
SELECT t.path_id, t.seq, t.change_at, CASE WHEN t.change_at='node' AND t.kind='vertical' THEN coalesce(f.kind,t.kind) ELSE t.kind END AS kind FROM {{o_trans}} t LEFT JOIN f ON f.path_id=t.path_id AND f.seq=t.seq""")
def attributed_transitions(w: World):
    return heights.attribute_transitions(cut(moves(w)), w.ways, w.nodes).select("path_id", "seq", F.col("at").alias("change_at"), "kind")


@query("platform_floor_vote", "O-98", """
WITH v AS (SELECT DISTINCT p.way_id, q.way_id AS voter, w.level FROM {fx_way_nodes} p JOIN {o_way} o ON o.way_id=p.way_id AND o.is_platform JOIN {fx_way_nodes} q ON q.node_id=p.node_id JOIN {o_way} w ON w.way_id=q.way_id WHERE w.level<>'' AND NOT w.is_platform),
b AS (SELECT way_id, level='1' AS flat, CASE WHEN level='1' THEN 1 ELSE 0 END AS lv FROM v UNION ALL SELECT way_id, false, 1 FROM v WHERE level='0;1'),
c AS (SELECT way_id, flat, lv, count(*) AS n FROM b GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY flat DESC, count(*) DESC, lv)=1)
SELECT o.way_id, CAST(coalesce(CASE WHEN o.level='1' THEN 1 END, c.lv) AS INT) AS level FROM {o_way} o LEFT JOIN c USING (way_id) WHERE o.is_platform""".replace("GROUP BY ALL QUALIFY", "GROUP BY way_id, flat, lv QUALIFY"))
def platform_floor_vote(w: World):
    return heights.platform_levels(w.ways.where(tg.is_any_platform("tags")), w.ways)


@query("gated_platforms", "O-99", f"""
WITH a AS (SELECT query_id AS relation_id, t_lat AS lat, t_lon AS lon FROM {{o_marker}})
SELECT DISTINCT f.relation_id, f.way_id FROM {{o_foot}} f JOIN {{o_way}} w USING (way_id) LEFT JOIN a USING (relation_id) LEFT JOIN {{fx_way_nodes}} wn ON wn.way_id=f.way_id LEFT JOIN {{fx_nodes}} n ON n.id=wn.node_id
WHERE w.highway='' AND w.tram='' AND (a.lat IS NULL OR {hav('n.lat','n.lon','a.lat','a.lon')}<=200)""")
def gated_platforms(w: World):
    st = stations(w)
    markers = platforms.complex_markers(st.centres.select(F.col("relation_id").alias("query_id"), "lat", "lon"), w.view("fx_overlay"))
    anchors = markers.selectExpr("query_id as relation_id", "t_lat as lat", "t_lon as lon")
    return heights.gate_platforms(st.footprint, anchors, w.ways, w.nodes)


@query("marker_floors", "O-100", f"""
WITH v AS (SELECT wn.way_id*1000+wn.pos AS point_id, n.st, n.lat, n.lon, o.l0 AS level FROM {{fx_way_nodes}} wn JOIN {{fx_nodes}} n ON n.id=wn.node_id JOIN {{o_way}} o USING (way_id) WHERE o.is_platform),
h AS (SELECT m.query_id, m.track, v.level FROM {{o_marker}} m JOIN v ON v.st=CAST(floor(m.query_id/10.0) AS BIGINT) AND {hav('m.t_lat','m.t_lon','v.lat','v.lon')}<=60 QUALIFY row_number() OVER (PARTITION BY m.query_id, m.track ORDER BY {hav('m.t_lat','m.t_lon','v.lat','v.lon')}, v.point_id)=1)
SELECT m.query_id, m.track, h.level, coalesce(h.level*4,0e0) AS z FROM {{o_marker}} m LEFT JOIN h USING (query_id, track)""")
def marker_floors(w: World):
    st = stations(w)
    markers = platforms.complex_markers(st.centres.select(F.col("relation_id").alias("query_id"), "lat", "lon"), w.view("fx_overlay")).selectExpr(
        "query_id", "track", "t_lat as lat", "t_lon as lon")
    level = F.element_at(tg.parse_levels(tg.tag("tags", "level")), 1).alias("level")
    pts = graph.way_points(w.ways.where(tg.is_any_platform("tags")), w.nodes, level).select(
        (F.col("way_id") * 1000 + F.col("pos")).alias("point_id"), "level", "lat", "lon")
    return heights.marker_levels(markers, pts)


PLANE = "sqrt(pow(({a}.lon-{b}.lon)*111320e0*cos(radians(o.lat0)),2)+pow(({a}.lat-{b}.lat)*111320e0,2))"


@query("pois_along_path", "O-101", f"""
SELECT p.path_id, x.id AS poi_id, round(min({PLANE.format(a='p', b='x')}),1) AS dist_m FROM {{o_pathpt}} p JOIN {{o_origin}} o USING (path_id) JOIN {{fx_pois}} x ON x.st=p.path_id GROUP BY p.path_id, x.id HAVING round(min({PLANE.format(a='p', b='x')}),1)<=40""")
def pois_along_path(w: World):
    return heights.pois_near_path(w.view("fx_pois"), path_points(w), 40.0)


DENIED = ",".join(f"'{x}'" for x in M.LANDMARK_DENIED)


@query("path_landmarks", "O-102", f"""
WITH s AS (SELECT h.path_id, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon, round(h.za/4) AS floor_no FROM {{o_hz}} h JOIN {{fx_nodes}} a ON a.id=h.a JOIN {{fx_nodes}} b ON b.id=h.b),
p AS (SELECT id, st, name, lat, lon, CAST(CASE level WHEN '' THEN '0' ELSE level END AS DOUBLE) AS lv FROM {{fx_pois}} WHERE name<>'' AND subtype NOT IN ({DENIED})),
c AS (SELECT s.path_id, p.id, p.name, {ENDS.replace('a.', 's.a_').replace('b.', 's.b_').replace('{p}.', 'p.')} FROM s JOIN p ON p.st=s.path_id AND p.lv=s.floor_no),
r AS (SELECT path_id, id, name, sqrt(min({DIST2})) AS d FROM (SELECT *, {CLAMP} FROM c) c2 GROUP BY path_id, id, name),
u AS (SELECT * FROM r WHERE d<=15 QUALIFY row_number() OVER (PARTITION BY path_id, lower(trim(name)) ORDER BY d, id)=1)
SELECT path_id, name, round(d,2) AS dist_m, rank FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY d, id) AS rank FROM u) v WHERE rank<=10""")
def path_landmarks(w: World):
    z = heights.hop_heights(hops(w), cut(heights.node_heights(w.ways, w.nodes)))
    at = w.nodes.select(F.col("id").alias("n"), "lat", "lon")
    floor = F.round(F.col("za") / M.FLOOR_HEIGHT_M)
    segs = z.join(at.selectExpr("n as a", "lat as a_lat", "lon as a_lon"), "a").join(
        at.selectExpr("n as b", "lat as b_lat", "lon as b_lon"), "b").withColumn("level", floor)
    pois = w.view("fx_pois").withColumn("level", F.element_at(tg.parse_levels(F.col("level")), 1))
    return heights.landmarks(pois, segs).select("path_id", "name", F.round("dist_m", 2).alias("dist_m"), "rank")


@query("walked_connectors", "O-103", """
SELECT p.path_id, p.way_id, k.kind FROM (SELECT path_id, way_id FROM {fx_path_way} UNION SELECT path_id, way_id FROM {o_hz} WHERE way_id IS NOT NULL AND abs(za-zb)>0.01) p JOIN {o_kind} k USING (way_id) WHERE k.kind IN ('stairs','escalator','elevator','ramp')""")
def walked_connectors(w: World):
    return heights.walked_connectors(w.ways, w.view("fx_path_way"), moves(w))


# ---- paths and cross-checks -----------------------------------------------------------
@query("walk_cutoffs", "O-55", f"""
SELECT q.relation_id, q.from_ref, q.to_ref, round(greatest(900e0, min({hav('m.lat','m.lon','n.lat','n.lon')})/1.4e0*3+60),1) AS cutoff_s FROM {{o_ask}} q JOIN {{o_own}} a ON a.relation_id=q.relation_id AND a.ref=q.from_ref JOIN {{fx_nodes}} m ON m.id=a.node_id
JOIN {{o_own}} b ON b.relation_id=q.relation_id AND b.ref=q.to_ref JOIN {{fx_nodes}} n ON n.id=b.node_id GROUP BY q.relation_id, q.from_ref, q.to_ref""")
def walk_cutoffs(w: World):
    st = stations(w)
    asked = all_pairs(st, w.relations)
    hit = platforms.resolve_platforms(
        asked.selectExpr("relation_id", "from_ref as ref").unionByName(asked.selectExpr("relation_id", "to_ref as ref")), st.footprint, w.ways)
    own = platforms.way_anchors(hit, st.platform_points)
    src = asked.join(own.withColumnRenamed("ref", "from_ref"), ["relation_id", "from_ref"])
    dst = asked.join(own.withColumnRenamed("ref", "to_ref"), ["relation_id", "to_ref"])
    cut_at = walks.walk_cutoff(src, dst, w.nodes)
    return asked.join(cut_at, "request_id").select("relation_id", "from_ref", "to_ref", F.round("cutoff_s", 1).alias("cutoff_s"))


@query("path_summaries", "O-56", """
SELECT w.relation_id, w.metres FROM {o_walk} w WHERE w.from_ref='1' AND w.to_ref='3' AND w.relation_id%10=1""")
def path_summaries(w: World):
    asked = w.relations.where(tg.tag("tags", "public_transport") == "stop_area").select(
        F.col("id").alias("request_id"), F.col("id").alias("relation_id"), F.lit("1").alias("from_ref"), F.lit("3").alias("to_ref"))
    hops_ = walks.path_hops(walk_between(stations(w), asked, with_path=True))
    return walks.path_summary(hops_, w.ways, w.nodes).select(F.col("request_id").alias("relation_id"), F.round("metres", 1).alias("metres"))


@query("simple_paths", "O-61", """
WITH p(st, src, node, seconds, seen, hops) AS (SELECT CAST(floor(id/500.0) AS BIGINT), id, id, 0e0, [id], 0 FROM {grid} WHERE rw=0 AND cl=0
  UNION ALL SELECT p.st, p.src, e.dst, p.seconds+e.seconds, list_append(p.seen, e.dst), p.hops+1 FROM p JOIN {o_along} e ON e.src=p.node AND e.src_lv=-1e9 AND e.dst_lv=-1e9 WHERE p.hops<4 AND NOT list_contains(p.seen, e.dst))
SELECT st AS search, hops, count(*) AS paths, round(min(p.seconds),3) AS best_s FROM p JOIN {grid} g ON g.id=p.node AND g.rw=1 GROUP BY st, hops""".replace("{grid} g ON g.id=p.node AND g.rw=1 GROUP BY st, hops", "{grid} g ON g.id=p.node AND g.rw=1 GROUP BY p.st, p.hops").replace("SELECT st AS search, hops,", "SELECT p.st AS search, p.hops,"))
def simple_paths(w: World):
    grid = w.view("grid")
    starts = grid.where("rw = 0 and cl = 0").select(F.col("st").alias("search"), F.col("id").alias("node"))
    ends = grid.where("rw = 1").select(F.col("st").alias("search"), F.col("id").alias("node"))
    found = walks.simple_paths(graph.walk_edges(w.ways, w.nodes), starts, ends, 4)
    return found.groupBy("search", "hops").agg(F.count(F.lit(1)).alias("paths"), F.round(F.min("seconds"), 3).alias("best_s"))


@query("way_hops", "O-62", """
WITH l AS (SELECT DISTINCT x.way_id AS a, y.way_id AS b FROM {fx_way_nodes} x JOIN {fx_way_nodes} y ON x.node_id=y.node_id AND x.way_id<>y.way_id WHERE x.way_id%1000<>300 AND y.way_id%1000<>300),
r(search, way_id, hops) AS (SELECT p*0+st, st*1000, 0 FROM {plat} WHERE p=0 UNION SELECT r.search, l.b, r.hops+1 FROM r JOIN l ON l.a=r.way_id WHERE r.hops<(SELECT count(DISTINCT a) FROM l WHERE a//1000=r.search))
SELECT search, way_id, min(hops) AS hops FROM r WHERE way_id%1000<20 GROUP BY search, way_id""")
def way_hops(w: World):
    kept = w.ways.where(tg.is_walkable("tags"))
    starts = w.view("plat").where("p = 0").select(F.col("st").alias("search"), (F.col("st") * 1000).alias("way_id"))
    goals = kept.where("id % 1000 < 20").select(F.floor(F.col("id") / 1000).alias("search"), F.col("id").alias("way_id"))
    return walks.way_hops(kept, starts, goals)


@query("way_breakdown", "O-63", """
SELECT p.path_id, count(*) AS n_ways, round(sum(s.total),1) AS metres, round(sum(s.total/w.speed+w.penalty),1) AS seconds FROM {fx_path_way} p JOIN {o_way} w USING (way_id) JOIN (SELECT DISTINCT way_id, total FROM {o_cum}) s USING (way_id) GROUP BY p.path_id""")
def way_breakdown(w: World):
    rows = walks.way_breakdown(w.view("fx_path_way"), w.ways, w.nodes)
    return walks.breakdown_totals(rows).select("path_id", "n_ways", F.round("metres", 1).alias("metres"), F.round("seconds", 1).alias("seconds"))


@query("opposite_platforms", "O-64", f"""
WITH s AS (SELECT DISTINCT a.way_id AS way_a, b.way_id AS way_b FROM {{fx_way_nodes}} a JOIN {{fx_way_nodes}} x ON x.node_id=a.node_id JOIN {{fx_way_nodes}} y ON y.way_id=x.way_id JOIN {{fx_way_nodes}} b ON b.node_id=y.node_id
  JOIN {{o_way}} o ON o.way_id=x.way_id WHERE a.way_id%1000 IN (0,5) AND b.way_id%1000 IN (5,10) AND a.way_id<b.way_id AND x.way_id NOT IN (a.way_id, b.way_id) AND o.walkable)
SELECT s.way_a, s.way_b, min(o.way_id) AS connecting_way, round(min(g.d),1) AS gap_m FROM s JOIN (SELECT DISTINCT a.way_id AS wa, b.way_id AS wb, x.way_id FROM {{fx_way_nodes}} a JOIN {{fx_way_nodes}} x ON x.node_id=a.node_id AND x.way_id<>a.way_id JOIN {{fx_way_nodes}} y ON y.way_id=x.way_id JOIN {{fx_way_nodes}} b ON b.node_id=y.node_id AND b.way_id<>y.way_id JOIN {{o_way}} k ON k.way_id=x.way_id WHERE k.walkable) o ON o.wa=s.way_a AND o.wb=s.way_b
JOIN (SELECT a.way_id AS wa, b.way_id AS wb, min({hav('m.lat','m.lon','n.lat','n.lon')}) AS d FROM {{fx_way_nodes}} a JOIN {{fx_nodes}} m ON m.id=a.node_id JOIN {{fx_nodes}} n ON n.st=m.st JOIN {{fx_way_nodes}} b ON b.node_id=n.id WHERE a.way_id%1000 IN (0,5) AND b.way_id%1000 IN (5,10) GROUP BY a.way_id, b.way_id) g ON g.wa=s.way_a AND g.wb=s.way_b GROUP BY s.way_a, s.way_b""")
def opposite_platforms(w: World):
    plat = w.ways.where("id % 1000 in (0, 5, 10)").select(F.floor(F.col("id") / 1000).alias("relation_id"), "id")
    a = plat.where("id % 1000 in (0, 5)").select("relation_id", F.col("id").alias("way_a"))
    b = plat.where("id % 1000 in (5, 10)").select("relation_id", F.col("id").alias("way_b"))
    pairs = a.join(b, "relation_id").where("way_a < way_b")
    return linkage.opposite_platforms(pairs, w.ways.where(tg.is_walkable("tags")), w.nodes).select(
        "way_a", "way_b", "connecting_way", F.round("gap_m", 1).alias("gap_m"))


@query("edge_stations", "O-65", """
WITH own AS (SELECT DISTINCT m.relation_id, wn.node_id FROM {fx_members} m JOIN {fx_way_nodes} wn ON wn.way_id=m.member_ref WHERE m.member_type='W' AND m.member_role='platform')
SELECT e.way_id, o.relation_id, 0 AS rounds, count(DISTINCT wn.node_id) AS shared FROM {o_way} e JOIN {fx_way_nodes} wn ON wn.way_id=e.way_id JOIN own o ON o.node_id=wn.node_id WHERE e.railway='platform_edge' GROUP BY e.way_id, o.relation_id""")
def edge_stations(w: World):
    edges = w.ways.where(tg.is_platform_edge("tags"))
    member_ways = w.members.where("member_type = 'W' and member_role = 'platform'").select("relation_id", F.col("member_ref").alias("way_id"))
    return linkage.edge_stations(edges, member_ways, w.ways)


@query("path_polylines", "O-116", """
SELECT p.path_id, count(*)-1 AS n_points, round(min(n.lat),6) AS lat, round(max(n.lon),6) AS lon FROM {fx_path_way} p JOIN {fx_way_nodes} wn USING (way_id) JOIN {fx_nodes} n ON n.id=wn.node_id GROUP BY p.path_id""")
def path_polylines(w: World):
    line = linkage.path_polyline(w.view("fx_path_way"), w.ways, w.nodes)
    return line.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.min("lat"), 6).alias("lat"), F.round(F.max("lon"), 6).alias("lon"))
