"""Registered queries over journeys, verdicts, delays and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.operators import delays, journeys, platforms, search, ways as way_ops
from footbridge.plans.graph_queries import search_view, stations
from footbridge.plans.registry import SHARED_VIEWS, hav, query
from footbridge.plans.stations import assess_changes
from footbridge.plans.world import World
from footbridge.session import cut

# ---- shared check views -----------------------------------------------------------
SHARED_VIEWS["o_leg"] = """
SELECT *, sum(CASE WHEN mode<>'walking' THEN 1 ELSE 0 END) OVER (PARTITION BY journey_id ORDER BY leg_no) AS n FROM {fx_legs}"""
SHARED_VIEWS["o_change"] = """
SELECT journey_id, CAST(n AS INT) AS change_no, st, arr_platform, arr_lat, arr_lon, arr_time, arr_s, leg_no AS arr_leg, lead(leg_no) OVER q AS dep_leg, lead(dep_platform) OVER q AS dep_platform, lead(dep_lat) OVER q AS dep_lat, lead(dep_lon) OVER q AS dep_lon,
  lead(dep_time) OVER q AS dep_time, lead(dep_s) OVER q AS dep_s, lead(bad_time) OVER q AS bad_dep, line AS arr_line, lead(line) OVER q AS dep_line,
  coalesce((SELECT sum(x.distance_m) FROM {o_leg} x WHERE x.journey_id=l.journey_id AND x.n=l.n AND x.mode='walking'),0) AS assumed_m
FROM {o_leg} l WHERE mode<>'walking' WINDOW q AS (PARTITION BY journey_id ORDER BY leg_no) QUALIFY lead(leg_no) OVER q IS NOT NULL"""
SHARED_VIEWS["o_ref_change"] = r"""
SELECT *, coalesce(nullif(trim(regexp_replace(trim(arr_platform), '(?i)^(gl|gleis)\s+', '')),''), nullif(trim(arr_platform),'')) AS arr_ref,
  coalesce(nullif(trim(regexp_replace(trim(dep_platform), '(?i)^(gl|gleis)\s+', '')),''), nullif(trim(dep_platform),'')) AS dep_ref,
  CASE WHEN NOT bad_dep THEN CAST(dep_s-arr_s AS DOUBLE) END AS layover_s, CAST(assumed_m AS DOUBLE)/1.4e0 AS assumed_s FROM {o_change}"""


def changes(w: World):
    """Changes of train of the derived legs; walk legs carry metres and their seconds."""
    legs = w.view("fx_legs").withColumn("duration_s", F.col("distance_m") / M.WALK_SPEED)
    return journeys.interchanges(legs)


@query("interchange_pairs", "O-66", """
SELECT journey_id, change_no, arr_platform, dep_platform, CAST(arr_leg AS BIGINT) AS arr_leg, CAST(dep_leg AS BIGINT) AS dep_leg, CAST(assumed_m AS DOUBLE) AS assumed_m, round(assumed_s,3) AS assumed_s FROM {o_ref_change}""")
def interchange_pairs(w: World):
    return changes(w).select("journey_id", "change_no", "arr_platform", "dep_platform", F.col("arr_leg_no").cast("long").alias("arr_leg"),
                             F.col("dep_leg_no").cast("long").alias("dep_leg"), "assumed_m", F.round("assumed_s", 3).alias("assumed_s"))


@query("layovers", "O-67", "SELECT journey_id, change_no, layover_s FROM {o_ref_change}")
def layovers(w: World):
    return journeys.with_times(changes(w)).select("journey_id", "change_no", "layover_s")


@query("shared_changes", "O-70", """
SELECT st, count(*) AS changes, count(DISTINCT coalesce(CAST(round(arr_lat,6) AS VARCHAR),'-')||'|'||coalesce(CAST(round(arr_lon,6) AS VARCHAR),'-')||'|'||coalesce(arr_platform,'-')||'|'||coalesce(CAST(round(dep_lat,6) AS VARCHAR),'-')||'|'||coalesce(CAST(round(dep_lon,6) AS VARCHAR),'-')||'|'||coalesce(dep_platform,'-')) AS distinct_changes FROM {o_change} GROUP BY st""")
def shared_changes(w: World):
    keyed, unique = journeys.distinct_changes(changes(w))
    st = F.floor(F.col("journey_id") / 500).alias("st")
    return keyed.select(st, "change_key").groupBy("st").agg(
        F.count(F.lit(1)).alias("changes"), F.count_distinct("change_key").alias("distinct_changes"))


@query("pending_changes", "O-76", """
SELECT journey_id, change_no, arr_ref, dep_ref, layover_s, 'pending' AS verdict, CAST(NULL AS VARCHAR) AS reason FROM {o_ref_change}""")
def pending_changes(w: World):
    return journeys.pending(changes(w))


# ---- assessed changes ----------------------------------------------------------------
SHARED_VIEWS["o_key"] = f"""
SELECT DISTINCT st, arr_ref, dep_ref, round(arr_lat,6) AS arr_lat, round(arr_lon,6) AS arr_lon, round(dep_lat,6) AS dep_lat, round(dep_lon,6) AS dep_lon,
  {hav('arr_lat','arr_lon','dep_lat','dep_lon')} AS gap_m FROM {{o_ref_change}} WHERE arr_ref IS NOT NULL AND dep_ref IS NOT NULL AND dep_lat IS NOT NULL"""
SHARED_VIEWS["o_end"] = """
SELECT DISTINCT st, arr_ref AS ref, arr_lat AS lat, arr_lon AS lon FROM {o_key} WHERE gap_m<=750 AND arr_ref IN ('98','99') UNION SELECT DISTINCT st, dep_ref, dep_lat, dep_lon FROM {o_key} WHERE gap_m<=750 AND dep_ref IN ('98','99')"""
SHARED_VIEWS["o_snap"] = f"""
SELECT e.*, n.id AS node_id FROM {{o_end}} e JOIN {{fx_nodes}} n ON n.st BETWEEN e.st-1 AND e.st+1 AND abs(n.lat-e.lat)<0.0005e0 AND abs(n.lon-e.lon)<0.0008e0 JOIN {{o_touch}} t ON t.node_id=n.id AND t.ped
WHERE {hav('e.lat','e.lon','n.lat','n.lon')}<=40 QUALIFY row_number() OVER (PARTITION BY e.st,e.ref,e.lat,e.lon ORDER BY {hav('e.lat','e.lon','n.lat','n.lon')}, n.id)=1"""
# a snapped spot on an isolated row is joined on like an isolated platform
SHARED_VIEWS["o_spot_way"] = """
SELECT s.node_id, min(t.way_id) AS way_id FROM (SELECT DISTINCT node_id FROM {o_snap}) s JOIN {o_touch} t ON t.node_id=s.node_id AND t.ped GROUP BY s.node_id"""
SHARED_VIEWS["o_start2"] = """
SELECT DISTINCT relation_id, ref, node_id, 0e0 AS s FROM {o_anchor} WHERE relation_id%10=1 UNION ALL SELECT DISTINCT -1, '@'||CAST(node_id AS VARCHAR), node_id, 0e0 FROM {o_snap}"""
SHARED_VIEWS["o_sp2"] = search_view(starts="SELECT * FROM {o_start2}").replace("o_sp", "o_sp2")
SHARED_VIEWS["o_place"] = """
SELECT relation_id, ref, relation_id AS p_rel, ref AS p_ref, node_id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon FROM {o_anchor} WHERE relation_id%10=1
UNION ALL SELECT st*10+1, ref, -1, '@'||CAST(node_id AS VARCHAR), node_id, lat, lon FROM {o_snap}"""
SHARED_VIEWS["o_key_walk"] = """
SELECT k.st, k.arr_ref, k.dep_ref, k.arr_lat, k.arr_lon, k.dep_lat, k.dep_lon, round(min(s.seconds),1) AS walk_s, round(arg_min(s.metres,s.seconds),1) AS walk_m
FROM {o_key} k JOIN (SELECT DISTINCT relation_id, ref, p_rel, p_ref, lat, lon FROM {o_place}) a ON a.relation_id=k.st*10+1 AND a.ref=k.arr_ref AND (a.lat IS NULL OR (a.lat=k.arr_lat AND a.lon=k.arr_lon))
JOIN {o_place} b ON b.relation_id=k.st*10+1 AND b.ref=k.dep_ref AND (b.lat IS NULL OR (b.lat=k.dep_lat AND b.lon=k.dep_lon))
JOIN {o_sp2} s ON s.relation_id=a.p_rel AND s.ref=a.p_ref AND s.node=b.node_id AND s.lv=-1e9 WHERE k.gap_m<=750 GROUP BY ALL"""
SHARED_VIEWS["o_near_station"] = f"""
SELECT k.st, k.arr_ref, k.dep_ref, k.arr_lat, k.arr_lon, k.dep_lat, k.dep_lon, s.relation_id, s.name FROM {{o_key}} k JOIN {{o_station}} s ON s.st BETWEEN k.st-1 AND k.st+1
WHERE CASE WHEN k.gap_m<=750 THEN least({hav('k.arr_lat','k.arr_lon','s.lat','s.lon')}, {hav('k.dep_lat','k.dep_lon','s.lat','s.lon')}) ELSE {hav('k.arr_lat','k.arr_lon','s.lat','s.lon')} END<=600
QUALIFY row_number() OVER (PARTITION BY k.st, k.arr_ref, k.dep_ref, k.arr_lat, k.arr_lon, k.dep_lat, k.dep_lon ORDER BY round(CASE WHEN k.gap_m<=750 THEN least({hav('k.arr_lat','k.arr_lon','s.lat','s.lon')}, {hav('k.dep_lat','k.dep_lon','s.lat','s.lon')}) ELSE {hav('k.arr_lat','k.arr_lon','s.lat','s.lon')} END,3), s.relation_id)=1"""
SHARED_VIEWS["o_assessed"] = f"""
SELECT c.journey_id, c.change_no, c.st, c.arr_ref, c.dep_ref, c.layover_s, c.assumed_s, w.walk_s, w.walk_m, n.relation_id, n.name AS station,
  CASE WHEN w.walk_s IS NOT NULL THEN NULL WHEN c.arr_ref IS NULL OR c.dep_ref IS NULL THEN 'no_platform_data' WHEN c.dep_lat IS NULL THEN 'station_unresolved'
    WHEN {hav('c.arr_lat','c.arr_lon','c.dep_lat','c.dep_lon')}>750 THEN 'cross_station' WHEN n.relation_id IS NULL THEN 'station_unresolved' ELSE 'disconnected' END AS reason
FROM {{o_ref_change}} c LEFT JOIN {{o_key_walk}} w ON w.st=c.st AND w.arr_ref=c.arr_ref AND w.dep_ref=c.dep_ref AND w.arr_lat=round(c.arr_lat,6) AND w.arr_lon=round(c.arr_lon,6) AND w.dep_lat=round(c.dep_lat,6) AND w.dep_lon=round(c.dep_lon,6)
LEFT JOIN {{o_near_station}} n ON n.st=c.st AND n.arr_ref=c.arr_ref AND n.dep_ref=c.dep_ref AND n.arr_lat=round(c.arr_lat,6) AND n.arr_lon=round(c.arr_lon,6) AND n.dep_lat=round(c.dep_lat,6) AND n.dep_lon=round(c.dep_lon,6)"""
SHARED_VIEWS["o_verdict"] = """
SELECT *, CASE WHEN walk_s IS NULL OR layover_s IS NULL THEN 'unknown' WHEN layover_s<walk_s THEN 'infeasible' WHEN layover_s<walk_s+60 THEN 'tight' ELSE 'feasible' END AS verdict FROM {o_assessed}"""


def assessed(w: World):
    """Every change of the derived journeys with its walk, written once per session and data folder."""
    def build():
        keyed, walked = assess_changes(stations(w), changes(w))
        walked = walked.withColumns({c: F.round(c, 1) for c in ("walk_s", "walk_m")})
        return keyed.join(walked, "change_key").select(
            "journey_id", "change_no", "arr_ref", "dep_ref", "layover_s", "assumed_s", "walk_s", "walk_m", "relation_id",
            "station", "reason", "source_by_coord", "target_by_coord", "arr_lat", "arr_lon", "dep_lat", "dep_lon", "arr_line", "dep_line")

    return w._stored("assessed", build)


@query("resolved_changes", "O-68", "SELECT journey_id, change_no, arr_ref, dep_ref, walk_s, walk_m, relation_id, station, reason FROM {o_assessed}")
def resolved_changes(w: World):
    return assessed(w).select("journey_id", "change_no", "arr_ref", "dep_ref", "walk_s", "walk_m", "relation_id", "station", "reason")


@query("change_verdicts", "O-69", """
SELECT journey_id, change_no, verdict, CASE WHEN walk_s IS NULL THEN reason WHEN verdict='unknown' THEN 'no_timing' END AS reason FROM {o_verdict}""")
def change_verdicts(w: World):
    return journeys.verdicts(assessed(w)).select("journey_id", "change_no", "verdict", "reason")


@query("journey_verdicts", "O-75", """
SELECT j.journey_id, coalesce(CASE min(CASE v.verdict WHEN 'infeasible' THEN 0 WHEN 'unknown' THEN 1 WHEN 'tight' THEN 2 WHEN 'feasible' THEN 3 END) WHEN 0 THEN 'infeasible' WHEN 1 THEN 'unknown' WHEN 2 THEN 'tight' WHEN 3 THEN 'feasible' END,'feasible') AS verdict, count(v.change_no) AS n_changes
FROM (SELECT DISTINCT journey_id FROM {fx_legs}) j LEFT JOIN {o_verdict} v USING (journey_id) GROUP BY j.journey_id""")
def journey_verdicts(w: World):
    return journeys.journey_verdicts(w.view("fx_legs"), journeys.verdicts(assessed(w)))


@query("recovered_labels", "O-77", f"""
WITH e AS (SELECT DISTINCT st, lat, lon, ref AS feed_ref FROM {{o_end}}),
m AS (SELECT e.*, n.ref AS label FROM e JOIN {{fx_nodes}} n ON n.st BETWEEN e.st-1 AND e.st+1 AND abs(n.lat-e.lat)<0.0016e0 WHERE (n.railway='stop' OR n.public_transport='stop_position') AND n.ref<>'' AND {hav('e.lat','e.lon','n.lat','n.lon')}<=160
  QUALIFY row_number() OVER (PARTITION BY e.st,e.lat,e.lon,e.feed_ref ORDER BY {hav('e.lat','e.lon','n.lat','n.lon')}, n.id)=1),
q AS (SELECT e.*, n.public_label AS label FROM e JOIN {{fx_quays}} n ON n.st BETWEEN e.st-1 AND e.st+1 WHERE {hav('e.lat','e.lon','n.lat','n.lon')}<=160
  QUALIFY row_number() OVER (PARTITION BY e.st,e.lat,e.lon,e.feed_ref ORDER BY {hav('e.lat','e.lon','n.lat','n.lon')}, n.station_key||'|'||n.public_label)=1)
SELECT DISTINCT round(e.lat,6) AS lat, round(e.lon,6) AS lon, e.feed_ref, m.label AS map_label, q.label AS operator_label, nullif(CASE WHEN q.label IS NULL THEN m.label WHEN m.label IS NOT NULL AND list_contains(string_split(q.label,'/'), m.label) THEN m.label ELSE q.label END, e.feed_ref) AS actual
FROM e LEFT JOIN m ON m.lat=e.lat AND m.lon=e.lon AND m.feed_ref=e.feed_ref LEFT JOIN q ON q.lat=e.lat AND q.lon=e.lon AND q.feed_ref=e.feed_ref""")
def recovered_labels(w: World):
    guarded = journeys.guard(journeys.distinct_changes(changes(w))[1]).where("ruled_out is null")
    ends = guarded.selectExpr("arr_ref as feed_ref", "round(arr_lat,6) as lat", "round(arr_lon,6) as lon").unionByName(
        guarded.selectExpr("dep_ref as feed_ref", "round(dep_lat,6) as lat", "round(dep_lon,6) as lon")).where("feed_ref in ('98', '99')").distinct()
    ends = cut(ends)  # read by both lookups and the join of them
    maps = platforms.nearest_label(ends, way_ops.numeric_track_nodes(w.nodes)).selectExpr("feed_ref", "lat", "lon", "label as map_label")
    quays = platforms.quay_at(ends, w.view("fx_quays")).selectExpr("feed_ref", "lat", "lon", "public_label as operator_label")
    keys = ["feed_ref", "lat", "lon"]
    both = ends.join(maps, keys, "left").join(quays, keys, "left").withColumn("by_coord", F.lit(True))
    return journeys.recover_labels(both).drop("by_coord")


SHARED_VIEWS["o_upd"] = "SELECT * FROM {fx_updates} QUALIFY row_number() OVER (PARTITION BY journey_id, change_no ORDER BY ts DESC, event_id DESC)=1"
SHARED_VIEWS["o_live"] = """
SELECT a.journey_id, a.change_no, a.walk_s, a.layover_s-coalesce(u.inbound_s,0)+coalesce(u.outbound_s,0) AS eff, a.layover_s, a.assumed_s, coalesce(u.cancelled,false) AS cancelled FROM {o_assessed} a LEFT JOIN {o_upd} u USING (journey_id, change_no)"""
LIVE_SQL = """
SELECT journey_id, change_no, CASE WHEN walk_s IS NULL OR layover_s IS NULL THEN 'unknown' WHEN eff<walk_s THEN 'infeasible' WHEN eff<walk_s+60 THEN 'tight' ELSE 'feasible' END AS verdict,
  CASE WHEN walk_s IS NOT NULL THEN eff END AS effective_s, round(eff-walk_s,1) AS margin_s, round(eff-walk_s-60,1) AS absorb_s, coalesce(walk_s IS NOT NULL AND layover_s IS NOT NULL AND eff<assumed_s AND eff>=walk_s, false) AS rescued, cancelled FROM {o_live}"""


def live_columns(df, *more):
    return df.select(*more, "journey_id", "change_no", "verdict", "effective_s", F.round("margin_s", 1).alias("margin_s"),
                     F.round("absorb_s", 1).alias("absorb_s"), "rescued", "cancelled")


@query("delay_reassessment", "O-78", LIVE_SQL)
def delay_reassessment(w: World):
    return live_columns(journeys.reassess(assessed(w), journeys.latest_updates(w.view("fx_updates"))))


@query("retracked_changes", "O-79", r"""
WITH n AS (SELECT a.journey_id, a.change_no, a.relation_id, a.arr_ref, a.dep_ref, a.walk_s, regexp_replace(u.arr_track_now, '(?i)^gleis\s+', '') AS an, u.dep_track_now AS dn FROM {o_assessed} a LEFT JOIN {o_upd} u USING (journey_id, change_no)),
c AS (SELECT *, coalesce(an<>arr_ref,false) OR coalesce(dn<>dep_ref,false) AS ch FROM n)
SELECT c.journey_id, c.change_no, CASE WHEN w.seconds IS NOT NULL THEN coalesce(an,arr_ref) ELSE arr_ref END AS arr_ref, CASE WHEN w.seconds IS NOT NULL THEN coalesce(dn,dep_ref) ELSE dep_ref END AS dep_ref,
  coalesce(w.seconds, walk_s) AS walk_s, w.seconds IS NOT NULL AS replanned FROM c LEFT JOIN {o_walk} w ON c.ch AND w.relation_id=c.relation_id AND w.relation_id%10=1 AND w.from_ref=coalesce(an,arr_ref) AND w.to_ref=coalesce(dn,dep_ref) AND w.from_ref IN ('1','2','3','4','5') AND w.to_ref IN ('1','2','3','4','5')""")
def retracked_changes(w: World):
    from footbridge.plans.survey_queries import pair_walks

    walks = pair_walks(w).where("found").selectExpr("relation_id", "from_ref as arr_ref", "to_ref as dep_ref", "seconds")
    out = journeys.retrack(assessed(w), journeys.latest_updates(w.view("fx_updates")), walks)
    return out.select("journey_id", "change_no", "arr_ref", "dep_ref", "walk_s", "replanned")


# ---- studies -------------------------------------------------------------------------
@query("best_itineraries", "O-80", """
WITH i AS (SELECT journey_id, CAST(floor(journey_id/4.0) AS BIGINT) AS query_id, max(arr_s) AS arrival_s, coalesce(max(distance_m),0) AS max_walk_m FROM {fx_legs} GROUP BY journey_id)
SELECT query_id, journey_id AS itinerary_id, CAST(arrival_s AS BIGINT) AS arrival_s, CAST(max_walk_m AS BIGINT) AS max_walk_m FROM i QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max_walk_m>1500, arrival_s, journey_id)=1""")
def best_itineraries(w: World):
    its = w.view("fx_legs").groupBy(F.col("journey_id").alias("itinerary_id")).agg(
        F.max("arr_s").cast("long").alias("arrival_s"), F.coalesce(F.max("distance_m"), F.lit(0)).cast("long").alias("max_walk_m"))
    return delays.best_itineraries(its.withColumn("query_id", F.floor(F.col("itinerary_id") / 4)))


SHARED_VIEWS["o_arrival"] = """
SELECT journey_id, st*10+1 AS hub, arr_ref, CAST(arr_s AS BIGINT) AS t_arr_s, CAST(arr_s+2400 AS BIGINT) AS baseline_s FROM {o_ref_change} WHERE change_no=1 AND arr_ref IS NOT NULL"""
SHARED_VIEWS["o_onward"] = r"""
SELECT DISTINCT hub, t_dep_s, dep_ref, first_value(final_s) OVER q AS final_s, first_value(line) OVER q AS line FROM (
  SELECT st*10+1 AS hub, CAST(dep_s AS BIGINT)+dep_late AS t_dep_s, coalesce(nullif(trim(regexp_replace(trim(dep_platform), '(?i)^(gl|gleis)\s+', '')),''), nullif(trim(dep_platform),'')) AS dep_ref, CAST(arr_s AS BIGINT)-600 AS final_s, line FROM {fx_legs} WHERE mode<>'walking') t
WINDOW q AS (PARTITION BY hub, t_dep_s, dep_ref ORDER BY final_s, line)"""
SHARED_VIEWS["o_opp"] = """
SELECT a.journey_id, a.hub, a.arr_ref, o.dep_ref, o.t_dep_s, o.final_s, w.seconds AS walk_s, o.t_dep_s-a.t_arr_s AS gap_s, a.baseline_s-o.final_s AS improves_s, a.baseline_s-o.final_s>60 AS improving, coalesce(o.t_dep_s-a.t_arr_s>=w.seconds+60,false) AS makeable
FROM {o_arrival} a JOIN {o_onward} o ON o.hub=a.hub AND o.t_dep_s BETWEEN a.t_arr_s AND a.t_arr_s+7200 LEFT JOIN {o_walk} w ON w.relation_id=a.hub AND w.from_ref=a.arr_ref AND w.to_ref=o.dep_ref AND w.from_ref<'6' AND w.to_ref<'6' AND length(w.from_ref)=1 AND length(w.to_ref)=1"""


def opps(w: World):
    from footbridge.plans.survey_queries import pair_walks

    hub = (F.floor(F.col("journey_id") / 500) * 10 + 1)
    first = journeys.guard(changes(w)).where("change_no = 1 and arr_ref is not null")
    legs = w.view("fx_legs")
    arr_s = legs.select("journey_id", F.col("leg_no").alias("arr_leg_no"), F.col("arr_s").cast("long").alias("t_arr_s"))
    arrivals = first.join(arr_s, ["journey_id", "arr_leg_no"]).select(
        "journey_id", hub.alias("hub"), "arr_ref", "t_arr_s", (F.col("t_arr_s") + 2400).alias("baseline_s"))
    onward = platforms.normalise_tracks(legs.where("mode <> 'walking'"), "dep_platform").select(
        (F.col("st") * 10 + 1).alias("hub"), (F.col("dep_s").cast("long") + F.col("dep_late")).alias("t_dep_s"),
        F.col("dep_platform").alias("dep_ref"), (F.col("arr_s").cast("long") - 600).alias("final_s"), "line")
    walks = pair_walks(w).where("found").selectExpr("relation_id as hub", "from_ref as arr_ref", "to_ref as dep_ref", "seconds")
    return delays.opportunities(arrivals, onward, walks)


@query("missed_connections", "O-81", """
SELECT journey_id, count(*) AS n_onward, CAST(min(gap_s) AS BIGINT) AS earliest_gap_s, count(*) FILTER (gap_s<=600) AS n_onward_10min, count(*) FILTER (improving) AS n_improving, bool_or(improving AND makeable) AS missed,
  CAST(coalesce(arg_min(improves_s, {key}) FILTER (improving AND makeable),0) AS BIGINT) AS best_saving_s FROM {o_opp} GROUP BY journey_id""".replace("{key}", "(final_s, t_dep_s, coalesce(dep_ref,''))"))
def missed_connections(w: World):
    return delays.onward_frequency(opps(w)).withColumns(
        {c: F.col(c).cast("long") for c in ("earliest_gap_s", "best_saving_s")})


@query("opportunity_report", "O-82", """
WITH b AS (SELECT * FROM {o_opp} WHERE improving QUALIFY row_number() OVER (PARTITION BY journey_id ORDER BY final_s, t_dep_s, coalesce(dep_ref,''))=1)
SELECT CASE WHEN makeable THEN 'confirmed' WHEN walk_s IS NULL THEN 'unvalidated' ELSE 'not_makeable' END AS tag, count(*) AS journeys, CAST(median(gap_s) AS DOUBLE) AS median_gap_s, CAST(median(improves_s) AS DOUBLE) AS median_saving_s FROM b GROUP BY 1""")
def opportunity_report(w: World):
    return delays.opportunity_report(opps(w))


@query("delay_sweep", "O-83", """
WITH i AS (SELECT relation_id AS hub, arr_ref, dep_ref, min(layover_s) AS gap, min(assumed_s) AS a, min(walk_s) AS w FROM {o_assessed} WHERE walk_s IS NOT NULL AND layover_s IS NOT NULL AND layover_s+1>=assumed_s AND walk_s<=layover_s GROUP BY relation_id, arr_ref, dep_ref, round(layover_s), round(assumed_s))
SELECT minutes, count(*) AS changes, count(*) FILTER (minutes*60>gap-a) AS dropped, count(*) FILTER (minutes*60>gap-a AND minutes*60<=gap-w) AS rescued, count(*) FILTER (minutes*60>gap-w) AS gone,
  round(CASE WHEN count(*) FILTER (minutes*60>gap-a)>0 THEN 100.0e0*count(*) FILTER (minutes*60>gap-a AND minutes*60<=gap-w)/count(*) FILTER (minutes*60>gap-a) END,1) AS rescued_pct
FROM i CROSS JOIN (SELECT unnest([1,2,3,4,5,7,10,15]) AS minutes) m GROUP BY minutes""")
def delay_sweep(w: World):
    rows = assessed(w).selectExpr("relation_id as hub", "arr_ref", "dep_ref", "layover_s as gap_s", "assumed_s", "walk_s")
    return delays.delay_sweep(rows)


SHARED_VIEWS["o_board"] = r"""
SELECT st AS hub, journey_id*10+leg_no AS seq, CASE WHEN leg_no%2=0 THEN 'S '||line ELSE line END AS line, 'Town '||CAST(journey_id%5 AS VARCHAR) AS dest,
  coalesce(nullif(trim(regexp_replace(trim(dep_platform), '(?i)^(gl|gleis)\s+', '')),''), nullif(trim(dep_platform),'')) AS platform FROM {fx_legs} WHERE mode<>'walking'"""
SHARED_VIEWS["o_ask_fill"] = """
SELECT journey_id*10+change_no AS ask_id, st AS hub, dep_line AS line, 'town '||CAST(journey_id%7 AS VARCHAR) AS headsign FROM {o_ref_change} WHERE dep_ref IS NULL"""
SHARED_VIEWS["o_fill"] = """
SELECT a.ask_id, b.platform, b.seq, contains(lower(b.dest), lower(a.headsign)) OR contains(lower(a.headsign), lower(b.dest)) AS same FROM {o_ask_fill} a JOIN {o_board} b ON b.hub=a.hub AND b.platform IS NOT NULL AND upper(replace(b.line,' ','')) LIKE '%'||upper(replace(a.line,' ',''))"""
SHARED_VIEWS["o_filled"] = """
SELECT a.ask_id, coalesce(e.platform, m.platform) AS platform, CASE WHEN e.platform IS NOT NULL THEN 'exact' WHEN m.kinds=1 THEN 'line_unique' WHEN m.kinds>1 THEN 'line_major' ELSE 'none' END AS how FROM {o_ask_fill} a
LEFT JOIN (SELECT ask_id, arg_min(platform, seq) AS platform FROM {o_fill} WHERE same GROUP BY ask_id) e USING (ask_id)
LEFT JOIN (SELECT ask_id, platform, count(*) OVER (PARTITION BY ask_id) AS kinds FROM (SELECT ask_id, platform, count(*) AS n, min(seq) AS s FROM {o_fill} GROUP BY ask_id, platform) v QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY n DESC, s)=1) m USING (ask_id)"""


def filled(w: World):
    legs = platforms.normalise_tracks(w.view("fx_legs").where("mode <> 'walking'"), "dep_platform")
    boards = legs.select(
        F.col("st").alias("hub"), (F.col("journey_id") * 10 + F.col("leg_no")).alias("seq"),
        F.when(F.col("leg_no") % 2 == 0, F.concat(F.lit("S "), "line")).otherwise(F.col("line")).alias("line"),
        F.concat(F.lit("Town "), (F.col("journey_id") % 5).cast("string")).alias("dest"), F.col("dep_platform").alias("platform"))
    asked = journeys.guard(changes(w)).where("dep_ref is null").select(
        (F.col("journey_id") * 10 + F.col("change_no")).alias("ask_id"), F.floor(F.col("journey_id") / 500).alias("hub"),
        F.col("dep_line").alias("line"), F.concat(F.lit("town "), (F.col("journey_id") % 7).cast("string")).alias("headsign"))
    return delays.fill_platforms(asked, boards)


@query("filled_platforms", "O-84", "SELECT ask_id, platform, how FROM {o_filled}")
def filled_platforms(w: World):
    return filled(w)


@query("hub_ids", "O-85", f"""
WITH t AS (SELECT s.relation_id AS hub_id, s.st, s.lat, s.lon FROM {{o_station}} s)
SELECT t.hub_id, arg_min(c.db_id, ({hav('t.lat','t.lon','c.latitude','c.longitude')}, c.db_id)) FILTER (c.is_main) AS main_id, count(*) AS n FROM t JOIN {{fx_catalog}} c ON abs(c.latitude-t.lat)<=0.04e0 AND abs(c.longitude-t.lon)<=0.06e0
WHERE c.db_id<>'' AND {hav('t.lat','t.lon','c.latitude','c.longitude')}<=1600 GROUP BY t.hub_id HAVING count(*) FILTER (c.is_main)>0""")
def hub_ids(w: World):
    hubs = stations(w).centres.select(F.col("relation_id").alias("hub_id"), F.lit("").alias("name"), "lat", "lon")
    best = delays.hub_ids(hubs, w.view("fx_catalog"))
    from footbridge.operators.spatial import radius_join

    index = w.view("fx_catalog").where("db_id <> ''").select("db_id", "is_main", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = radius_join(hubs.select("hub_id", "lat", "lon"), index, M.HUB_RADIUS_M).groupBy("hub_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_main").alias("mains")).where("mains > 0")
    return best.join(near, "hub_id").select("hub_id", F.col("db_id").alias("main_id"), "n")


@query("fill_report", "O-86", """
SELECT 'departure' AS side, f.how, count(*) AS filled, count(w.seconds) AS routed FROM {o_filled} f JOIN {o_ref_change} c ON c.journey_id*10+c.change_no=f.ask_id
LEFT JOIN {o_walk} w ON w.relation_id=c.st*10+1 AND w.from_ref=c.arr_ref AND w.to_ref=f.platform AND w.from_ref<'6' AND w.to_ref<'6' AND length(w.from_ref)=1 AND length(w.to_ref)=1 WHERE f.platform IS NOT NULL GROUP BY f.how""")
def fill_report(w: World):
    from footbridge.plans.survey_queries import pair_walks

    supplied = filled(w).where("platform is not null")
    base = journeys.guard(changes(w)).where("dep_ref is null").select(
        (F.col("journey_id") * 10 + F.col("change_no")).alias("ask_id"), "arr_ref", (F.floor(F.col("journey_id") / 500) * 10 + 1).alias("relation_id"))
    walks = pair_walks(w).where("found").selectExpr("relation_id", "from_ref as arr_ref", "to_ref as platform", "seconds as walk_s")
    rows = base.join(supplied, "ask_id").join(walks, ["relation_id", "arr_ref", "platform"], "left").select(
        "walk_s", F.lit("feed").alias("arr_src"), F.lit(None).cast("string").alias("arr_how"), F.lit("board").alias("dep_src"), F.col("how").alias("dep_how"))
    return delays.fill_report(rows)


# ---- search --------------------------------------------------------------------------
SHARED_VIEWS["o_cat"] = "SELECT *, lower(strip_accents(name)) AS own, lower(strip_accents(trim(alias))) AS oth FROM {fx_catalog}"
SHARED_VIEWS["o_skey"] = "SELECT id AS idx, is_main, own, own AS key FROM {o_cat} UNION ALL SELECT id, is_main, own, oth FROM {o_cat} WHERE oth<>'' AND oth<>own"
SHARED_VIEWS["o_term"] = """
SELECT DISTINCT term FROM (SELECT unnest([substr(name, 1, 1), substr(name, 1, 2), substr(name, 1, 3), substr(name, 1, 4), substr(name, 3, 4), name]) AS term FROM {fx_catalog}) WHERE trim(term)<>''"""
SHARED_VIEWS["o_found"] = """
SELECT term, idx, row_number() OVER (PARTITION BY term ORDER BY o) AS rank FROM (SELECT t.term, k.idx, min((NOT starts_with(k.key, q), NOT k.is_main, k.key, k.idx)) AS o
  FROM (SELECT term, lower(strip_accents(trim(term))) AS q FROM {o_term}) t JOIN {o_skey} k ON contains(k.key, t.q) GROUP BY t.term, k.idx) z QUALIFY row_number() OVER (PARTITION BY term ORDER BY o)<=10"""


def catalog_keys(w: World):
    return search.search_keys(w.view("fx_catalog").select(F.col("id").alias("idx"), "name", "alias", "is_main"))


def terms(w: World):
    """Starts of one to four letters, inner parts and whole names, as people type them."""
    asked = [F.substring("name", 1, n) for n in (1, 2, 3, 4)] + [F.substring("name", 3, 4), F.col("name")]
    return w.view("fx_catalog").select(F.explode(F.array(*asked)).alias("term")).where("trim(term) <> ''").distinct()


@query("search_keys", "O-71", "SELECT idx, key FROM {o_skey}")
def search_keys(w: World):
    return catalog_keys(w).select("idx", "key")


@query("station_search", "O-72", "SELECT term, idx, rank FROM {o_found}")
def station_search(w: World):
    return search.search_stations(terms(w), catalog_keys(w)).withColumn("rank", F.col("rank").cast("long"))


@query("station_names_resolved", "O-73", """
WITH t AS (SELECT term FROM {o_term} UNION SELECT name FROM {fx_catalog} UNION SELECT alias FROM {fx_catalog} WHERE alias<>''),
e AS (SELECT t.term, k.idx FROM t JOIN {o_skey} k ON k.key=lower(strip_accents(trim(t.term))) QUALIFY row_number() OVER (PARTITION BY t.term ORDER BY NOT k.is_main, k.own<>k.key, k.idx)=1),
s AS (SELECT t.term, k.idx FROM t JOIN {o_skey} k ON contains(k.key, lower(strip_accents(trim(t.term)))) WHERE t.term NOT IN (SELECT term FROM e)
  QUALIFY row_number() OVER (PARTITION BY t.term ORDER BY NOT starts_with(k.key, lower(strip_accents(trim(t.term)))), NOT k.is_main, k.key, k.idx)=1)
SELECT term, idx, 'exact' AS how FROM e UNION ALL SELECT term, idx, 'search' FROM s""")
def station_names_resolved(w: World):
    c = w.view("fx_catalog")
    asked = terms(w).union(c.select("name")).union(c.where("alias <> ''").select("alias")).distinct()
    return search.resolve_names(asked, catalog_keys(w))


@query("map_station_index", "O-74", """
SELECT 'osm-r'||CAST(relation_id AS VARCHAR) AS id, CASE WHEN name_en<>'' THEN name_en ELSE name END AS name, n_members>=10 AS is_main,
  CASE WHEN name_en<>'' THEN lower(name)||','||replace(lower(name),' ','')||','||lower(name_en)||','||replace(lower(name_en),'-','') ELSE lower(name)||','||replace(lower(name),' ','') END AS keys FROM {o_station} WHERE name NOT LIKE '%->%'""")
def map_station_index(w: World):
    return search.map_station_index(stations(w).centres, w.relations).select("id", "name", "is_main", F.array_join("keys", ",").alias("keys"))


@query("station_catalogue", "O-12", """
SELECT id, name, round(latitude,6) AS latitude, round(longitude,6) AS longitude, country, nullif(db_id,'') AS db_id, is_main, CASE WHEN lower(strip_accents(trim(alias)))<>lower(strip_accents(name)) THEN nullif(trim(alias),'') END AS alias FROM {fx_catalog} WHERE suggestable""")
def station_catalogue(w: World):
    c = w.view("fx_catalog").withColumns({k: F.col(k).cast("string") for k in ("latitude", "longitude")})
    return search.station_catalog(c).withColumns({k: F.round(k, 6) for k in ("latitude", "longitude")})
