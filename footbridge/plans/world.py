"""A station world derived from the driver's tables, for checking operators at any scale.

The driver's tables hold no map data. Every 500 orders become one station: a 20 x 25 grid of
nodes with platforms on rows 0, 5, 10 and 15, columns of stairs, escalator, lift and footway,
and stations that differ in how platform 4 is joined on. The view texts are plain SQL that
Spark and DuckDB both run; they specify inputs and hold no operator logic.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footbridge.session import cut, tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# name -> SQL over the driver's tables and earlier views
VIEWS: dict[str, str] = {}

VIEWS["grid"] = """
SELECT o_orderkey AS id, CAST(floor(o_orderkey/500.0) AS BIGINT) AS st,
  CAST(floor((o_orderkey%500)/25.0) AS INT) AS rw, CAST(o_orderkey%25 AS INT) AS cl,
  o_orderpriority AS pr, o_orderstatus AS os, CAST(floor(o_totalprice) AS BIGINT)%50 AS jit
FROM {orders}"""
VIEWS["plat"] = """
SELECT st, rw, CAST(floor(rw/5.0) AS INT) AS p FROM {grid} WHERE rw%5=0 AND cl=0"""
VIEWS["corner"] = """
SELECT 4000000000000+st*40+p*4+k AS id, st, p, k,
  47.0e0+st*0.02e0+(rw-CASE WHEN p=3 AND st%12=5 THEN 3.6e0 ELSE 1.4e0 END)*0.0002e0 AS lat,
  8.0e0+(CASE WHEN p=3 AND st%12=5 AND k=0 THEN 27e0 WHEN p=3 AND st%12=5 THEN -3e0 WHEN k=0 THEN 9e0 ELSE 3e0 END)*0.0003e0 AS lon
FROM (SELECT st, rw, p, 0 AS k FROM {plat} UNION ALL SELECT st, rw, p, 1 AS k FROM {plat}) c"""
VIEWS["fx_nodes"] = """
SELECT id, st, rw, cl, 47.0e0+st*0.02e0+rw*0.0002e0+jit*0.000001e0 AS lat,
  8.0e0+cl*0.0003e0+((jit*7)%50)*0.000001e0 AS lon,
  CASE WHEN cl=16 AND rw%5=2 THEN 'elevator' ELSE '' END AS highway,
  CASE WHEN rw=0 AND cl=0 THEN 'station' WHEN pr='1-URGENT' AND os='F' THEN 'stop' ELSE '' END AS railway,
  CASE WHEN pr='1-URGENT' AND os<>'F' AND NOT (rw=0 AND cl=0) THEN 'stop_position' ELSE '' END AS public_transport,
  CASE WHEN pr='1-URGENT' AND os='O' THEN 'yes' ELSE '' END AS bus,
  CASE WHEN pr='1-URGENT' THEN CAST(rw AS STRING) ELSE '' END AS ref,
  CASE WHEN rw=0 AND cl=0 THEN 'Halt '||CAST(st AS STRING) ELSE '' END AS name,
  CASE WHEN st%2=1 AND cl IN (0,8) AND rw=0 THEN '1' WHEN st%2=1 AND cl IN (0,8) AND rw IN (11,12,14,19) THEN '0' ELSE '' END AS level
FROM {grid}
UNION ALL
SELECT id, st, -1, -1, lat, lon, '', '', '', '', '', '', '' FROM {corner}"""
VIEWS["fx_way_nodes"] = """
SELECT st*1000+rw AS way_id, cl AS pos, id AS node_id FROM {grid}
UNION ALL
SELECT st*1000+100+cl, rw, id FROM {grid}
WHERE cl%8=0 AND NOT (st%6=2 AND rw>14) AND NOT (st%12=5 AND rw>12) AND NOT (st%12=11 AND rw>11)
UNION ALL SELECT st*1000+200+CAST(floor(rw/5.0) AS INT), 0, id FROM {grid} WHERE rw%5=0 AND cl=3
UNION ALL SELECT st*1000+200+CAST(floor(rw/5.0) AS INT), 1, id FROM {grid} WHERE rw%5=0 AND cl=9
UNION ALL SELECT st*1000+200+p, 2+k, id FROM {corner}
UNION ALL SELECT st*1000+200+CAST(floor(rw/5.0) AS INT), 4, id FROM {grid} WHERE rw%5=0 AND cl=3
UNION ALL SELECT st*1000+300, CASE WHEN rw=0 AND cl=0 THEN 0 WHEN rw=0 THEN 1 WHEN cl=24 THEN 2 ELSE 3 END, id
FROM {grid} WHERE rw IN (0,19) AND cl IN (0,24)
UNION ALL SELECT st*1000+300, 4, id FROM {grid} WHERE rw=0 AND cl=0"""
VIEWS["fx_ways"] = """
SELECT way_id, st,
  CASE WHEN k>=200 AND k<300 THEN 'platform' WHEN k<100 AND k%5=0 AND st%3=1 THEN 'platform_edge' WHEN k<100 AND k%5=0 THEN 'platform' ELSE '' END AS railway,
  CASE WHEN k<100 AND k%5<>0 AND k<>17 THEN 'footway' WHEN k=100 THEN 'steps' WHEN k=116 THEN 'elevator' WHEN k IN (108,124) THEN 'footway' ELSE '' END AS highway,
  CASE WHEN k=108 THEN 'forward' ELSE '' END AS conveying,
  CASE WHEN p<0 THEN '' WHEN st%3=1 AND p=1 AND k<100 THEN '' WHEN st%3=0 AND p=2 THEN '' WHEN st%3=0 AND p=3 THEN '4; 5' ELSE CAST(p+1 AS STRING) END AS ref,
  CASE WHEN st%3=0 AND p=2 THEN '3' ELSE '' END AS local_ref,
  CASE WHEN st%3=1 AND p=1 AND k<100 THEN '402/412' ELSE '' END AS track_ref,
  CASE WHEN k>=100 AND k<200 THEN '0;1' WHEN k<100 AND k>=10 AND k<>17 THEN '1' WHEN k>=202 AND k<300 THEN '1' ELSE '' END AS level,
  CASE WHEN k>=200 AND k<300 THEN 'yes' ELSE '' END AS area,
  CASE WHEN k=300 THEN 'station' ELSE '' END AS public_transport,
  CASE WHEN k=216 THEN 'yes' ELSE '' END AS tram
FROM (SELECT way_id, CAST(floor(way_id/1000.0) AS BIGINT) AS st, CAST(way_id%1000 AS INT) AS k,
  CASE WHEN way_id%1000>=200 AND way_id%1000<300 THEN CAST(way_id%1000 AS INT)-200
       WHEN way_id%1000<100 AND way_id%1000%5=0 THEN CAST(floor(way_id%1000/5.0) AS INT) ELSE -1 END AS p
  FROM (SELECT DISTINCT way_id FROM {fx_way_nodes}) d) t"""
VIEWS["fx_members"] = """
SELECT st*10+1 AS relation_id, rw AS sequence, 'W' AS member_type, st*1000+rw AS member_ref, 'platform' AS member_role FROM {plat}
UNION ALL SELECT st*10+1, 50, 'W', st*1000+300, '' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+1, 100, 'N', st*500, 'stop' FROM {plat} WHERE p=0 AND st%5<>4
UNION ALL SELECT st*10+2, 0, 'R', st*10+1, '' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+2, 1, 'R', st*10+2, '' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+3, 0, 'W', st*1000+17, 'outer' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+4, 0, 'W', st*1000+17, 'outer' FROM {plat} WHERE p=0"""
VIEWS["fx_relations"] = """
SELECT st*10+1 AS id, st, 'stop_area' AS public_transport, 'public_transport' AS type,
  CASE WHEN st%10=9 THEN 'A -> B '||CAST(st AS STRING) ELSE 'Halt '||CAST(st%7 AS STRING) END AS name,
  CASE WHEN st%4=0 THEN 'Stop-'||CAST(st AS STRING) ELSE '' END AS name_en,
  CASE WHEN st%2=0 THEN 'CH' ELSE '' END AS country, '' AS highway, '' AS level FROM {plat} WHERE p=0
UNION ALL SELECT st*10+2, st, 'stop_area_group', 'public_transport', 'Knoten '||CAST(st AS STRING), '', '', '', '' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+3, st, '', 'multipolygon', 'Hall', '', '', 'pedestrian', '1' FROM {plat} WHERE p=0
UNION ALL SELECT st*10+4, st, '', 'multipolygon', 'Hall', '', '', 'corridor', '2' FROM {plat} WHERE p=0"""
VIEWS["fx_pois"] = """
SELECT id, st, CASE os WHEN 'O' THEN 'shop' ELSE 'amenity' END AS category,
  CASE os WHEN 'F' THEN 'toilets' WHEN 'O' THEN 'coffee' ELSE 'bench' END AS subtype,
  CASE WHEN id%3=0 THEN '' ELSE 'Kiosk '||CAST(jit AS STRING) END AS name,
  CASE WHEN rw>=10 THEN '1' WHEN cl>12 THEN '0' ELSE '' END AS level,
  47.00005e0+st*0.02e0+rw*0.0002e0 AS lat, 8.00005e0+cl*0.0003e0 AS lon
FROM {grid} WHERE pr='2-HIGH'"""
VIEWS["leg0"] = """
SELECT l_orderkey AS journey_id, CAST(l_linenumber AS INT) AS leg_no, min(l_partkey) AS pk, min(l_suppkey) AS sk
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
VIEWS["leg1"] = """
SELECT journey_id, leg_no, pk, sk, CAST(floor(journey_id/500.0) AS BIGINT) AS st,
  CAST(pk%4 AS INT) AS pd, CAST((pk+sk)%4 AS INT) AS pa,
  leg_no*1800 AS dep_s, leg_no*1800+1800-CAST((pk*7+leg_no*13)%40 AS INT)*15 AS arr_s,
  CASE WHEN pk%5=0 THEN CAST(pk%7 AS INT)*60 ELSE 0 END AS dep_late, CASE WHEN sk%4=0 THEN CAST(sk%9 AS INT)*60-60 ELSE 0 END AS arr_late
FROM {leg0}"""
VIEWS["fx_legs"] = """
SELECT journey_id, leg_no, st, CASE WHEN leg_no%4=3 THEN 'walking' ELSE 'rail' END AS mode,
  CASE WHEN (pk*7+leg_no)%11=0 THEN NULL WHEN sk%13=0 THEN '99' WHEN sk%9=0 THEN 'Gleis '||CAST(pd+1 AS STRING) ELSE CAST(pd+1 AS STRING) END AS dep_platform,
  CASE WHEN (pk*5+leg_no)%19=0 THEN ' ' WHEN (pk+leg_no)%23=0 THEN '98' WHEN pk%9=0 THEN 'gl '||CAST(pa+1 AS STRING) ELSE CAST(pa+1 AS STRING) END AS arr_platform,
  CASE WHEN pk%29=0 THEN NULL ELSE 47.00002e0+(st+CASE WHEN sk%17=0 THEN 1 ELSE 0 END)*0.02e0+pd*5*0.0002e0 END AS dep_lat,
  8.00004e0+CAST(pk%5 AS INT)*0.0015e0 AS dep_lon,
  47.00002e0+st*0.02e0+pa*5*0.0002e0 AS arr_lat, 8.00004e0+CAST(sk%5 AS INT)*0.0015e0 AS arr_lon,
  CASE WHEN pk%37=0 THEN 'n/a' ELSE '2024-01-01T'||lpad(CAST(CAST(floor(dep_s/3600.0) AS INT) AS STRING),2,'0')||':'||lpad(CAST(CAST(floor((dep_s%3600)/60.0) AS INT) AS STRING),2,'0')||':'||lpad(CAST(dep_s%60 AS STRING),2,'0')||'Z' END AS dep_time,
  '2024-01-01T'||lpad(CAST(CAST(floor(arr_s/3600.0) AS INT) AS STRING),2,'0')||':'||lpad(CAST(CAST(floor((arr_s%3600)/60.0) AS INT) AS STRING),2,'0')||':'||lpad(CAST(arr_s%60 AS STRING),2,'0')||'Z' AS arr_time,
  dep_s, arr_s, dep_late, arr_late, pk%37=0 AS bad_time,
  CASE WHEN leg_no%4=3 THEN CAST(pk%2500 AS INT) END AS distance_m, 'L'||CAST(pk%12 AS STRING) AS line, sk%41=0 AS cancelled
FROM {leg1}"""
VIEWS["fx_updates"] = """
SELECT event_id, ts, CAST(floor(event_id/8.0) AS BIGINT) AS journey_id, CAST(event_id%4 AS INT)+1 AS change_no,
  CASE WHEN event_type='error' THEN round(value*6) ELSE 0e0 END AS inbound_s,
  CASE WHEN event_type='click' THEN round(value*4) ELSE 0e0 END AS outbound_s,
  CASE WHEN event_type='purchase' THEN 'Gleis '||CAST(event_id%4+1 AS STRING) END AS arr_track_now,
  CASE WHEN event_type='view' AND user_id%2=0 THEN CAST(user_id%4+1 AS STRING) END AS dep_track_now,
  user_id%31=0 AS cancelled
FROM {events}"""
VIEWS["fx_coaches"] = """
SELECT l_orderkey AS train_id, CAST(l_linenumber AS INT) AS ord, min(l_quantity)+5e0 AS len_m, min(l_returnflag) AS class
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
VIEWS["fx_overlay"] = """
SELECT 'Main '||CAST(st AS STRING) AS station, st, 47.0e0+st*0.02e0+0.001e0 AS st_lat, 8.003e0 AS st_lon,
  CAST(p+1 AS STRING) AS track, 47.00001e0+st*0.02e0+rw*0.0002e0 AS lat, 8.00361e0 AS lon, p+1 AS n FROM {plat} WHERE st%2=0
UNION ALL
SELECT 'Sub '||CAST(st AS STRING), st, 47.0e0+st*0.02e0+0.002e0, 8.0035e0, CAST(p+4 AS STRING),
  47.00001e0+st*0.02e0+rw*0.0002e0+0.0001e0, 8.0051e0, 1 FROM {plat} WHERE st%2=0 AND p<3"""
VIEWS["fx_quays"] = """
SELECT 'de:'||CAST(st AS STRING) AS station_key, st, 'Hub '||CAST(st AS STRING) AS name, p, CASE p WHEN 0 THEN '1/2' ELSE CAST(p+1 AS STRING) END AS public_label,
  47.00003e0+st*0.02e0+rw*0.0002e0 AS lat, 8.0031e0 AS lon,
  CASE (st+p)%3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS step_free,
  CASE (st+p)%4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS wheelchair, (st+p)%5=0 AS has_lift
FROM {plat} WHERE st%3<>2"""
VIEWS["fx_catalog"] = """
SELECT doc_id AS id, trim(split_part(replace(text, chr(10), ' '), ' ', 1)||' '||split_part(replace(text, chr(10), ' '), ' ', 2)) AS name,
  47.0e0+(doc_id%97)*0.02e0 AS latitude, 8.0e0+(doc_id%13)*0.001e0 AS longitude, lang AS country,
  doc_id%10=0 AS is_main, CASE WHEN doc_id%7=0 THEN split_part(replace(text, chr(10), ' '), ' ', 3) WHEN doc_id%7=1 THEN lower(split_part(replace(text, chr(10), ' '), ' ', 1)||' '||split_part(replace(text, chr(10), ' '), ' ', 2)) ELSE '' END AS alias,
  CASE WHEN doc_id%3=0 THEN CAST(8000000+doc_id AS STRING) ELSE '' END AS db_id, doc_id%6<>5 AS suggestable
FROM {documents}"""
VIEWS["fx_rings"] = """
SELECT st AS ring_id, CASE WHEN rw=0 THEN cl ELSE 49-cl END AS pos,
  cl*0.4e0+(cl%2)*0.0001e0 AS x, CAST(st+rw AS DOUBLE) AS y FROM {grid} WHERE rw IN (0,1)
UNION ALL SELECT st, 50, 0e0, CAST(st AS DOUBLE) FROM {grid} WHERE rw=0 AND cl=0"""

VIEWS["fx_path"] = """
SELECT st AS path_id, cl AS seq, id AS node_id FROM {grid} WHERE rw=0
UNION ALL SELECT st, 24+rw, id FROM {grid} WHERE cl=24 AND rw BETWEEN 1 AND 10
UNION ALL SELECT st, 34+(24-cl), id FROM {grid} WHERE rw=10 AND cl BETWEEN 12 AND 23"""
VIEWS["fx_path_way"] = """
SELECT path_id, 0 AS ord, path_id*1000 AS way_id FROM {fx_path} WHERE seq=0
UNION ALL SELECT path_id, 1, path_id*1000+124 FROM {fx_path} WHERE seq=0 UNION ALL SELECT path_id, 2, path_id*1000+10 FROM {fx_path} WHERE seq=0"""

_DEP = re.compile(r"\{(\w+)\}")


def oracle_text(sql: str, extra: dict[str, str] | None = None) -> str:
    """A query with ``{view}`` references as one standalone statement with its views inlined."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in views:
            return
        for dep in _DEP.findall(views[name]):
            visit(dep)
        order.append(name)

    for name in _DEP.findall(sql):
        visit(name)

    def plain(text: str) -> str:
        return _DEP.sub(lambda m: m.group(1), text).strip()

    body = plain(sql)
    ctes = []
    for v in order:
        text = plain(views[v])
        ctes.append(text if text.startswith(f"{v}(") else f"{v} AS ({text})")
    if body.upper().startswith("WITH "):
        rest = body[5:].lstrip()
        rest = rest[10:] if rest.upper().startswith("RECURSIVE ") else rest
        return f"WITH RECURSIVE {', '.join([*ctes, rest])}"
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body


# Views several queries read are written once per session and data folder, the way a map is
# loaded once before it is queried. The element tables below are written the same way.
STORED = ("fx_nodes", "fx_way_nodes", "fx_ways", "fx_legs")
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


class World:
    """Lazy access to the derived tables, in view form and in element form."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = cut(build())
        return _WRITTEN[key]

    def view(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in self._views:
            def build() -> DataFrame:
                deps = {d: self.view(d) for d in _DEP.findall(VIEWS[name])}
                return self.spark.sql(VIEWS[name], **deps)

            self._views[name] = self._stored(name, build) if name in STORED else build()
        return self._views[name]

    def _tags(self, df: DataFrame, **columns: str):
        pairs = [c for key, col in columns.items() for c in (F.lit(key.replace("__", ":")), F.col(col))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v != "").alias("tags")

    @cached_property
    def nodes(self) -> DataFrame:
        v = self.view("fx_nodes")
        return self._stored("nodes", lambda: v.select("id", "lat", "lon", self._tags(
            v, highway="highway", railway="railway", public_transport="public_transport", bus="bus",
            ref="ref", name="name", level="level")))

    @cached_property
    def ways(self) -> DataFrame:
        def build() -> DataFrame:
            tags = self.view("fx_ways")
            lists = self.view("fx_way_nodes").groupBy("way_id").agg(
                F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("nodes"))
            return tags.join(lists, "way_id").select(F.col("way_id").alias("id"), "nodes", self._tags(
                tags, railway="railway", highway="highway", conveying="conveying", ref="ref", local_ref="local_ref",
                railway__track_ref="track_ref", level="level", area="area", public_transport="public_transport", tram="tram"))

        return self._stored("ways", build)

    @cached_property
    def members(self) -> DataFrame:
        return self._stored("members", lambda: self.view("fx_members"))

    @cached_property
    def relations(self) -> DataFrame:
        v = self.view("fx_relations")
        return self._stored("relations", lambda: v.select("id", self._tags(
            v, public_transport="public_transport", type="type", name="name", name__en="name_en",
            country="country", highway="highway", level="level")))
