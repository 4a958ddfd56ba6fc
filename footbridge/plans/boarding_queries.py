"""Registered queries over boarding positions and ring topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from footbridge.functions import tags as tg
from footbridge.operators import boarding, topology
from footbridge.plans.graph_queries import search_view, stations
from footbridge.plans.registry import SHARED_VIEWS, hav, query
from footbridge.plans.stations import graph_edges
from footbridge.plans.world import World

SHARED_VIEWS["o_line"] = "SELECT st, st*1000 AS line, pos, node_id, lat, lon, cum, total AS length_m FROM {o_cum} c JOIN {fx_ways} w USING (way_id) WHERE way_id%1000=0"
SHARED_VIEWS["o_len"] = "SELECT DISTINCT line AS platform, length_m FROM {o_line}"
SHARED_VIEWS["o_seats0"] = "SELECT train_id, CAST(floor(train_id/500.0) AS BIGINT)*1000 AS platform, ord AS coach, ord, len_m, count(*) OVER (PARTITION BY train_id) AS n, sum(len_m) OVER (PARTITION BY train_id ORDER BY ord) AS upto, row_number() OVER (PARTITION BY train_id ORDER BY ord) AS k, train_id%5 AS mode FROM {fx_coaches}"
SHARED_VIEWS["o_sector"] = """
SELECT l.platform, chr(CAST(65+i AS INT)) AS sector, CASE WHEN l.platform%3000=0 THEN l.length_m*i/4 WHEN l.platform%3000=1000 AND i=0 THEN 0e0 WHEN l.platform%3000=1000 THEN (l.length_m*(2*i+1)/8.0e0+l.length_m*(2*i-1)/8.0e0)/2 ELSE l.length_m*i/4 END AS start_m,
  CASE WHEN l.platform%3000=1000 AND i=3 THEN l.length_m WHEN l.platform%3000=1000 THEN (l.length_m*(2*i+1)/8.0e0+l.length_m*(2*i+3)/8.0e0)/2 ELSE l.length_m*(i+1)/4 END AS end_m FROM {o_len} l CROSS JOIN (SELECT unnest([0,1,2,3]) AS i) s"""
SHARED_VIEWS["o_span"] = """
SELECT c.train_id, c.platform, c.coach, CASE WHEN mode<2 THEN upto-len_m WHEN mode=2 THEN s.start_m WHEN mode=3 THEN (k-1)*l.length_m/n ELSE (n-k)*l.length_m/n END AS start_m,
  CASE WHEN mode<2 THEN upto WHEN mode=2 THEN s.end_m WHEN mode=3 THEN k*l.length_m/n ELSE (n-k+1)*l.length_m/n END AS end_m
FROM {o_seats0} c JOIN {o_len} l USING (platform) LEFT JOIN {o_sector} s ON s.platform=c.platform AND s.sector=chr(CAST(65+(c.ord%4) AS INT))"""


def lines(w: World):
    rows = w.view("fx_way_nodes").where("way_id % 1000 = 0").select(F.col("way_id").alias("line"), "pos", "node_id")
    return w._stored("platform_lines", lambda: boarding.polylines(rows, w.nodes))


def lengths(w: World):
    return lines(w).select(F.col("line").alias("platform"), "length_m").distinct()


def sectors(w: World):
    p = lengths(w)
    i = F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("i")
    s = p.select("platform", "length_m", i)
    signs = s.select(
        "platform", F.chr(F.col("i") + 65).alias("sector"), F.col("i").alias("ord"),
        F.when(F.col("platform") % 3000 == 0, F.col("length_m") * F.col("i") / 4).alias("start_m"),
        F.when(F.col("platform") % 3000 == 0, F.col("length_m") * (F.col("i") + 1) / 4).alias("end_m"),
        F.when(F.col("platform") % 3000 == 1000, F.col("length_m") * (2 * F.col("i") + 1) / 8.0).alias("sign_m"))
    return boarding.sector_map(signs, p)


@query("sector_map", "O-105", "SELECT platform, sector, round(start_m,3) AS start_m, round(end_m,3) AS end_m FROM {o_sector}")
def sector_map(w: World):
    return sectors(w).select("platform", "sector", F.round("start_m", 3).alias("start_m"), F.round("end_m", 3).alias("end_m"))


def spans(w: World):
    from pyspark.sql import Window

    c = w.view("fx_coaches").withColumn("mode", F.col("train_id") % 5)
    order = Window.partitionBy("train_id").orderBy("ord")
    upto = F.sum("len_m").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = c.withColumn("upto", upto).withColumn("k", F.row_number().over(order)).select(
        "train_id", (F.floor(F.col("train_id") / 500) * 1000).alias("platform"), F.col("ord").alias("coach"), F.col("k").alias("ord"),
        F.when(F.col("mode") == 2, F.array(F.lower(F.chr((F.col("ord") % 4) + 65)))).otherwise(F.array().cast("array<string>")).alias("sectors"),
        F.when(F.col("mode") < 2, F.col("upto") - F.col("len_m")).alias("start_m"), F.when(F.col("mode") < 2, F.col("upto")).alias("end_m"),
        (F.col("mode") == 4).alias("reversed"))
    return boarding.coach_spans(rows, sectors(w), lengths(w))


@query("coach_spans", "O-104", "SELECT train_id, coach, round(start_m,3) AS start_m, round(end_m,3) AS end_m FROM {o_span}")
def coach_spans(w: World):
    return spans(w).select("train_id", "coach", F.round("start_m", 3).alias("start_m"), F.round("end_m", 3).alias("end_m"))


SHARED_VIEWS["o_seat"] = "SELECT s.train_id*10+s.coach AS seat_id, s.platform AS line, start_m+((s.train_id%60)+1-0.5e0)/60*(end_m-start_m) AS offset_m FROM {o_span} s"
SHARED_VIEWS["o_bracket"] = """
SELECT s.*, q.length_m, q.c0, q.c1, q.a_lat, q.a_lon, q.b_lat, q.b_lon, q.node_a, q.node_b FROM {o_seat} s JOIN (SELECT line, length_m, cum AS c0, lead(cum) OVER r AS c1, lat AS a_lat, lon AS a_lon, lead(lat) OVER r AS b_lat, lead(lon) OVER r AS b_lon, node_id AS node_a, lead(node_id) OVER r AS node_b FROM {o_line} WINDOW r AS (PARTITION BY line ORDER BY pos)) q
ON q.line=s.line AND q.node_b IS NOT NULL AND q.c0<=least(greatest(s.offset_m,0),q.length_m) QUALIFY row_number() OVER (PARTITION BY s.seat_id ORDER BY q.c0 DESC)=1"""


def alighting(w: World):
    seats = w.view("fx_coaches").select(
        (F.col("train_id") * 10 + F.col("ord")).alias("seat_id"), "train_id", (F.floor(F.col("train_id") / 500) * 1000).alias("platform"),
        F.col("ord").alias("coach"), ((F.col("train_id") % 60) + 1).alias("seat"), F.lit(60).alias("seats_per_coach"))
    return boarding.alighting_points(seats, spans(w), lines(w))


@query("alighting_points", "O-106", """
SELECT seat_id, round(offset_m,4) AS offset_m, offset_m<0 OR offset_m>length_m AS clamped, round(a_lat+(b_lat-a_lat)*(least(greatest(offset_m,0),length_m)-c0)/(c1-c0),6) AS lat, round(a_lon+(b_lon-a_lon)*(least(greatest(offset_m,0),length_m)-c0)/(c1-c0),6) AS lon FROM {o_bracket}""")
def alighting_points(w: World):
    return alighting(w).select("seat_id", F.round("offset_m", 4).alias("offset_m"), "clamped", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("coach_at_offset", "O-107", """
WITH o AS (SELECT train_id, platform, CAST(train_id%400 AS DOUBLE) AS off FROM {o_seats0} WHERE k=1)
SELECT o.train_id AS offset_id, s.coach FROM o JOIN {o_span} s USING (train_id, platform) QUALIFY row_number() OVER (PARTITION BY o.train_id ORDER BY CASE WHEN off<start_m THEN start_m-off WHEN off>end_m THEN off-end_m ELSE 0 END, start_m, s.coach)=1""")
def coach_at_offset(w: World):
    offsets = w.view("fx_coaches").select("train_id").distinct().select(
        F.col("train_id").alias("offset_id"), "train_id", (F.floor(F.col("train_id") / 500) * 1000).alias("platform"), (F.col("train_id") % 400).cast("double").alias("offset_m"))
    return boarding.coach_at(offsets, spans(w))


SHARED_VIEWS["o_spot"] = """
SELECT line, node_a, node_b, seat_id, (least(greatest(offset_m,0),length_m)-c0)/1.4e0 AS ta, (c1-least(greatest(offset_m,0),length_m))/1.4e0 AS tb, count(*) OVER (PARTITION BY line, node_a, node_b) AS n_seats FROM {o_bracket}"""
SHARED_VIEWS["o_door"] = "SELECT seat_id, line, n_seats, node_a AS node_id, ta AS t FROM {o_spot} UNION ALL SELECT seat_id, line, n_seats, node_b, tb FROM {o_spot}"
# a search per vertex beside a door; every seat adds its own way along the platform
SHARED_VIEWS["o_sp_seat"] = search_view(starts="SELECT DISTINCT node_id AS relation_id, 'x' AS ref, node_id, 0e0 AS s FROM {o_door}").replace("o_sp(", "o_sp_seat(").replace("FROM o_sp p", "FROM o_sp_seat p").replace("recurring.o_sp ", "recurring.o_sp_seat ")


@query("seat_walks", "O-108", """
SELECT s.seat_id, s.n_seats, count(q.seconds)>0 AS found, round(min(s.t+q.seconds),1) AS seconds, round(arg_min(s.t*1.4e0+q.metres,s.t+q.seconds),1) AS metres FROM {o_door} s
LEFT JOIN (SELECT w.line, w.node_id, min(p.seconds) AS seconds, arg_min(p.metres,p.seconds) AS metres FROM (SELECT DISTINCT line, node_id FROM {o_door}) w JOIN {fx_way_nodes} g ON g.way_id=w.line+5 JOIN {o_sp_seat} p ON p.relation_id=w.node_id AND p.node=g.node_id AND p.lv=-1e9 GROUP BY w.line, w.node_id) q
ON q.line=s.line AND q.node_id=s.node_id GROUP BY s.seat_id, s.n_seats""")
def seat_walks(w: World):
    # the goal is the station's second platform row
    from footbridge.session import cut

    spot = ["platform", "node_a", "node_b"]
    seats = cut(alighting(w).select("seat_id", *spot, "to_a_s", "to_b_s").withColumn("goal_key", F.col("platform") + 5))
    spots = cut(seats.groupBy(*spot).agg(F.count(F.lit(1)).alias("n_seats")))
    goals = w.view("fx_way_nodes").where("way_id % 1000 = 5").select(F.col("way_id").alias("goal_key"), "node_id")
    keep = spots.select(F.col("node_a").alias("node_id")).unionByName(spots.select(F.col("node_b").alias("node_id")))
    edges = graph_edges(stations(w), keep)
    out = boarding.seat_walks(seats, goals, edges)
    return out.join(seats.join(spots, spot).select("seat_id", "n_seats"), "seat_id").select(
        "seat_id", "n_seats", "found", F.round("seconds", 1).alias("seconds"), F.round("metres", 1).alias("metres"))


@query("stepoff_guidance", "O-109", f"""
WITH g AS (SELECT wn.way_id-5 AS line, avg(n.lat) AS g_lat, avg(n.lon) AS g_lon FROM {{fx_way_nodes}} wn JOIN {{fx_nodes}} n ON n.id=wn.node_id WHERE wn.way_id%1000=205 OR wn.way_id%1000=5 GROUP BY wn.way_id-5),
e AS (SELECT line, arg_min(lat,pos) AS a_lat, arg_min(lon,pos) AS a_lon, arg_max(lat,pos) AS b_lat, arg_max(lon,pos) AS b_lon FROM {{o_line}} GROUP BY line),
o AS (SELECT l.line, l.node_id, l.length_m, CASE WHEN {hav('a_lat','a_lon','g_lat','g_lon')}<{hav('b_lat','b_lon','g_lat','g_lon')} THEN l.length_m-l.cum ELSE l.cum END AS o FROM {{o_line}} l JOIN e USING (line) JOIN g ON g.line=l.line)
SELECT node_id AS walk_id, round(length_m,1) AS platform_length_m, round(o,1) AS stepoff_offset_m, round(o/length_m,3) AS stepoff_fraction, round(greatest(o,length_m-o)/1.4e0,1) AS time_saved_s, CASE WHEN greatest(o,length_m-o)/1.4e0>=40 THEN 'high' WHEN greatest(o,length_m-o)/1.4e0>=12 THEN 'some' ELSE 'low' END AS significance FROM o""")
def stepoff_guidance(w: World):
    starts = lines(w).select(F.col("node_id").alias("walk_id"), "line", "node_id", (F.col("line") + 5).alias("goal"))
    goals = w.view("fx_way_nodes").where("way_id % 1000 = 5").select(F.col("way_id").alias("goal"), "node_id").join(
        w.nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    return boarding.stepoff(starts, lines(w), goals)


BOX = (-1.0, 0.0, 30.0, 1.0e9)
SHARED_VIEWS["o_prep"] = "SELECT ring_id, pos, round(x,3) AS x, y FROM {fx_rings}"
SHARED_VIEWS["o_rhop"] = "SELECT ring_id, pos, x, y, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM {o_prep} WINDOW q AS (PARTITION BY ring_id ORDER BY pos)"


def prepared(w: World):
    return topology.prepare_rings(w.view("fx_rings"), BOX, 0.01)


@query("prepared_rings", "O-111", "SELECT ring_id, CAST(pos AS BIGINT) AS pos, x, y FROM {o_prep}")
def prepared_rings(w: World):
    return prepared(w).withColumn("pos", F.col("pos").cast("long"))


@query("edge_ownership", "O-112", """
SELECT least(x,x2) AS x1, least(y,y2) AS y1, greatest(x,x2) AS x2, greatest(y,y2) AS y2, string_agg(CAST(ring_id AS VARCHAR), ',' ORDER BY ring_id) AS owners, CASE WHEN max(y)=0 AND max(y2)=0 THEN 'clip' WHEN count(*)>1 THEN 'border' ELSE 'coast' END AS kind FROM {o_rhop} WHERE x2 IS NOT NULL GROUP BY 1,2,3,4""".replace("GROUP BY 1,2,3,4", "GROUP BY least(x,x2), least(y,y2), greatest(x,x2), greatest(y,y2)"))
def edge_ownership(w: World):
    e = topology.edge_owners(prepared(w), BOX)
    return e.select(
        F.col("lo.x").alias("x1"), F.least("lo.y", "hi.y").alias("y1"), F.col("hi.x").alias("x2"), F.greatest("lo.y", "hi.y").alias("y2"),
        F.array_join(F.transform("owners", lambda r: r.cast("string")), ",").alias("owners"), "kind")


# arcs from the edges: runs of one owner set around each ring, then the lesser of both directions
SHARED_VIEWS["o_ring_side"] = "SELECT *, least({'x': x, 'y': y}, {'x': x2, 'y': y2}) AS a, greatest({'x': x, 'y': y}, {'x': x2, 'y': y2}) AS b FROM {o_rhop} WHERE x2 IS NOT NULL"
SHARED_VIEWS["o_ring_own"] = "SELECT a, b, array_to_string(list_sort(list_distinct(list(ring_id))), ',') AS owners, CAST(count(DISTINCT ring_id) AS INT) AS n FROM {o_ring_side} GROUP BY a, b"
SHARED_VIEWS["o_ring_flag"] = """
SELECT h.*, o.owners, o.n, coalesce(lag(o.owners) OVER q<>o.owners, false) AS begins, count(*) OVER (PARTITION BY ring_id) AS m, first_value(o.owners) OVER r AS fo, last_value(o.owners) OVER r AS lo
FROM {o_ring_side} h JOIN {o_ring_own} o USING (a, b) WINDOW q AS (PARTITION BY ring_id ORDER BY pos), r AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
SHARED_VIEWS["o_ring_run"] = "SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY ring_id ORDER BY pos) AS run0, sum(CAST(begins AS INT)) OVER (PARTITION BY ring_id) AS runs FROM {o_ring_flag}"
SHARED_VIEWS["o_ring_place_run"] = "SELECT *, CASE WHEN run0=0 AND fo=lo THEN runs ELSE run0 END AS run, CASE WHEN run0=0 AND fo=lo AND runs>0 THEN pos+m ELSE pos END AS ord FROM {o_ring_run}"
SHARED_VIEWS["o_ring_fwd"] = "SELECT ring_id, run, owners, n, list_append(list({'x': x, 'y': y} ORDER BY ord), {'x': arg_max(x2,ord), 'y': arg_max(y2,ord)}) AS f FROM {o_ring_place_run} GROUP BY ring_id, run, owners, n"
SHARED_VIEWS["o_ring_arc"] = "SELECT DISTINCT owners, n, least(f, list_reverse(f)) AS f FROM {o_ring_fwd}"


def traced(w: World):
    rings = prepared(w)
    return topology.arc_points(rings, topology.edge_owners(rings, BOX))


@query("shared_arcs", "O-113", "SELECT owners, CAST(len(f) AS INT) AS n_points, n AS n_owners, CASE WHEN n>1 THEN 'border' ELSE 'coast' END AS kind FROM {o_ring_arc}")
def shared_arcs(w: World):
    return topology.shared_arcs(traced(w)).drop("arc_key")


@query("arc_points", "O-113", "SELECT owners, n AS n_owners, CAST(len(f) AS INT) AS n_points, CAST(i-1 AS BIGINT) AS seq, f[i].x AS x, f[i].y AS y FROM (SELECT *, unnest(range(1, len(f)+1)) AS i FROM {o_ring_arc}) a")
def arc_points(w: World):
    return traced(w).drop("arc_key").withColumn("seq", F.col("seq").cast("long"))
