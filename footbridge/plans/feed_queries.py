"""Registered queries over feeds: payloads are built from the given tables, then parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from footbridge.functions import tags as tg
from footbridge.functions.text import track_ref
from footbridge.plans.registry import query
from footbridge.plans.world import World
from footbridge.session import scratch_dir
from footbridge.sources import feeds


def new_folder(w: World, kind: str) -> str:
    return f"{scratch_dir(w.spark)}/{kind}-{uuid.uuid4().hex}"


def stop_table(w: World):
    """A timetable feed's stops, every column text."""
    legs = w.view("fx_legs")
    stops = legs.select(
        (F.col("journey_id") * 10 + F.col("leg_no")).cast("string").alias("stop_id"), F.lit("own").alias("stop_name"), F.lit("0").alias("location_type"),
        F.when(F.col("leg_no") % 2 == 0, F.concat(F.lit("S"), "st")).otherwise("").alias("parent_station"), F.col("arr_platform").alias("platform_code"),
        F.col("arr_lat").cast("string").alias("stop_lat"), F.col("arr_lon").cast("string").alias("stop_lon"))
    parents = legs.select("st").distinct().select(
        F.concat(F.lit("S"), "st").alias("stop_id"), F.concat(F.lit("Halt "), "st").alias("stop_name"), F.lit("1").alias("location_type"),
        F.lit("").alias("parent_station"), F.lit("").alias("platform_code"), F.lit("0").alias("stop_lat"), F.lit("0").alias("stop_lon"))
    return stops.unionByName(parents)


STOPS_SQL = r"""
SELECT CAST(journey_id*10+leg_no AS VARCHAR) AS stop_id, CASE WHEN leg_no%2=0 THEN 'Halt '||CAST(st AS VARCHAR) ELSE 'own' END AS station, trim(arr_platform) AS code, round(arr_lat,6) AS lat FROM {fx_legs}
WHERE trim(arr_platform)<>'' AND trim(arr_platform) NOT LIKE '% %'"""


@query("feed_platforms", "O-05", STOPS_SQL)
def feed_platforms(w: World):
    return feeds.feed_platforms(stop_table(w)).select("stop_id", "station", "code", F.round("lat", 6).alias("lat"))


@query("stop_file_platforms", "O-05", STOPS_SQL)
def stop_file_platforms(w: World):
    path = new_folder(w, "stops")
    stop_table(w).write.option("header", True).csv(path)
    return feeds.feed_platforms(feeds.read_stops(w.spark, path)).select("stop_id", "station", "code", F.round("lat", 6).alias("lat"))


def stop_place_texts(w: World):
    """One XML element a stop place."""
    q = w.view("fx_quays")

    def flag(c):
        return F.when(F.col(c), "true").when(~F.col(c), "false").otherwise("unknown")

    quay = F.concat(
        F.lit("<Quay><Name>Bahnsteig Gleis "), F.col("public_label"), F.lit("</Name><Centroid><Location><Longitude>"), F.col("lon").cast("string"), F.lit("</Longitude><Latitude>"),
        F.col("lat").cast("string"), F.lit("</Latitude></Location></Centroid><AccessibilityAssessment><limitations><AccessibilityLimitation><WheelchairAccess>"), flag("wheelchair"),
        F.lit("</WheelchairAccess><StepFreeAccess>"), flag("step_free"), F.lit("</StepFreeAccess></AccessibilityLimitation></limitations></AccessibilityAssessment>"),
        F.when(F.col("has_lift"), "<equipmentPlaces><EquipmentPlace><placeEquipments><LiftEquipmentRef>x</LiftEquipmentRef></placeEquipments></EquipmentPlace></equipmentPlaces>").otherwise(""), F.lit("</Quay>"))
    return q.withColumn("x", quay).groupBy("station_key", "name").agg(F.concat(
        F.lit("<StopPlace id=\"dhid:"), F.first("station_key"), F.lit(":EdB\"><Name>"), F.first("name"), F.lit("</Name><quays>"), F.array_join(F.collect_list("x"), ""),
        F.lit("<Quay><Name>Bus</Name></Quay></quays></StopPlace>")).alias("xml"))


QUAYS_SQL = """
SELECT station_key, name, public_label, round(lat,6) AS lat, step_free, has_lift FROM {fx_quays}"""


@query("stop_place_quays", "O-06", QUAYS_SQL)
def stop_place_quays(w: World):
    places = stop_place_texts(w).select(F.from_xml("xml", feeds.STOP_PLACE).alias("p")).select("p.*")
    return feeds.stop_quays(places).select("station_key", "name", "public_label", F.round("lat", 6).alias("lat"), "step_free", "has_lift")


@query("stop_place_file_quays", "O-06", QUAYS_SQL)
def stop_place_file_quays(w: World):
    path = new_folder(w, "places")
    # a file is one document with one root, of up to a hundred stop places
    part = F.floor(F.substring_index("station_key", ":", -1).cast("long") / 100)
    files = stop_place_texts(w).groupBy(part.alias("part")).agg(F.concat(F.lit("<Delivery>"), F.array_join(F.collect_list("xml"), ""), F.lit("</Delivery>")).alias("xml"))
    files.select("xml").write.option("maxRecordsPerFile", 1).text(path)
    return feeds.stop_quays(feeds.read_stop_places(w.spark, path)).select("station_key", "name", "public_label", F.round("lat", 6).alias("lat"), "step_free", "has_lift")


@query("quay_overlay", "O-07", """
WITH q AS (SELECT *, st*10+p AS seq, CASE WHEN p=3 THEN '3' ELSE public_label END AS lbl FROM {fx_quays}), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY station_key, lbl ORDER BY seq)=1)
SELECT station_key, lbl AS public_label, round(avg(lat) OVER (PARTITION BY station_key),6) AS st_lat, step_free, name FROM f""")
def quay_overlay(w: World):
    q = w.view("fx_quays").withColumns({
        "seq": F.col("st") * 10 + F.col("p"), "public_label": F.when(F.col("p") == 3, "3").otherwise(F.col("public_label")), "eva": F.lit(None).cast("string")})
    return feeds.merge_quays(q).select("station_key", "public_label", F.round("st_lat", 6).alias("st_lat"), "step_free", "name")


def plans(w: World):
    """Planner answers as JSON text, one itinerary per derived journey, built by Spark."""
    def place(track, lat, lon):
        return F.struct(F.col(track).alias("track"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.lit("x").alias("name"))

    def late(time, by):
        t = F.to_timestamp(F.regexp_replace(time, "Z", ""), "yyyy-MM-dd'T'HH:mm:ss")
        return F.date_format(t - F.make_dt_interval(secs=F.col(by).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    good = w.view("fx_legs").withColumn("sched_dep", F.when(~F.col("bad_time"), late(F.when(~F.col("bad_time"), F.col("dep_time")), "dep_late")).otherwise(F.col("dep_time")))
    leg = F.struct(
        "leg_no", F.when(F.col("mode") == "walking", "WALK").otherwise("RAIL").alias("mode"), F.col("line").alias("routeShortName"), F.col("dep_time").alias("startTime"),
        F.col("sched_dep").alias("scheduledStartTime"), F.col("arr_time").alias("endTime"), late("arr_time", "arr_late").alias("scheduledEndTime"),
        F.col("distance_m").cast("double").alias("distance"), "cancelled", place("dep_platform", "dep_lat", "dep_lon").alias("from"), place("arr_platform", "arr_lat", "arr_lon").alias("to"),
        F.array(F.struct(F.lit("mid").alias("name"), F.col("arr_platform").alias("track"), F.col("arr_time").alias("arrival"), late("arr_time", "arr_late").alias("scheduledArrival"))).alias("intermediateStops"))
    its = good.groupBy(F.col("journey_id").alias("plan_id")).agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    text = its.select("plan_id", F.to_json(F.struct(F.array(F.struct("legs")).alias("itineraries"))).alias("value"))
    return feeds.parse_plans(text)


@query("plan_legs", "O-08", """
SELECT journey_id AS plan_id, row_number() OVER (PARTITION BY journey_id ORDER BY leg_no)-1 AS leg_no, mode, CASE WHEN mode<>'walking' THEN line END AS train_name, dep_platform, arr_platform,
  CASE WHEN NOT bad_time THEN nullif(CAST(dep_late AS BIGINT),0) END AS dep_delay_s, nullif(CAST(arr_late AS BIGINT),0) AS arr_delay_s, distance_m, cancelled FROM {fx_legs}""")
def plan_legs(w: World):
    return feeds.legs_from_plans(plans(w)).select(
        "plan_id", F.col("leg_no").cast("long").alias("leg_no"), "mode", "train_name", "dep_platform", "arr_platform", "dep_delay_s", "arr_delay_s", "distance_m", "cancelled")


@query("plan_stopovers", "O-09", """
SELECT journey_id AS plan_id, row_number() OVER (PARTITION BY journey_id ORDER BY leg_no)-1 AS leg_no, 'mid' AS station, arr_platform AS track, nullif(CAST(arr_late AS BIGINT),0) AS arr_delay_s FROM {fx_legs}""")
def plan_stopovers(w: World):
    return feeds.stopovers(plans(w)).select("plan_id", F.col("leg_no").cast("long").alias("leg_no"), "station", "track", "arr_delay_s")


@query("departure_boards", "O-10", r"""
SELECT st AS hub, line AS train, coalesce(nullif(trim(regexp_replace(trim(dep_platform), '(?i)^(gl|gleis)\s+', '')),''), nullif(trim(dep_platform),'')) AS platform, CAST(dep_late/60 AS INT) AS delay_min, count(*) AS n FROM {fx_legs} WHERE mode<>'walking' AND line IN ('L1','L2','L3') GROUP BY ALL""")
def departure_boards(w: World):
    d = F.struct(
        F.col("line").alias("train"), F.col("leg_no").cast("string").alias("trainNumber"), F.array(F.when(F.col("line").isin("L1", "L2", "L3"), "F").otherwise("N")).alias("trainClasses"),
        F.col("dep_time").alias("scheduledDeparture"), (F.col("dep_late") / 60).cast("int").alias("delayDeparture"), track_ref(F.col("dep_platform")).alias("platform"), F.lit("X").alias("destination"))
    # one board per station and hour of departures, as a feed is polled
    boards = w.view("fx_legs").where("mode <> 'walking'").groupBy(F.col("st").alias("hub"), F.floor(F.col("dep_s") / 3600).alias("h"), F.floor(F.col("journey_id") / 50).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(d).alias("departures"))).alias("value"))
    return feeds.long_distance(feeds.departures(boards)).groupBy("hub", "train", "platform", "delay_min").agg(F.count(F.lit(1)).alias("n"))


@query("coach_feeds", "O-11", """
SELECT CAST(train_id AS VARCHAR) AS train_id, CASE train_id%3 WHEN 0 THEN 'DE' WHEN 1 THEN 'CH' ELSE 'FR' END AS country, CAST(ord AS VARCHAR) AS coach, ord, CASE WHEN train_id%3=1 AND ord%2=0 THEN 'A,B' WHEN train_id%3=0 THEN 'C' ELSE '' END AS sectors,
  CASE WHEN train_id%3=0 THEN (ord*5.0e0)/100*200 END AS start_m, CASE WHEN train_id%3=0 THEN (ord*5.0e0+5)/100*200 END AS end_m FROM {fx_coaches} WHERE NOT (train_id%3=0 AND class='N')""")
def coach_feeds(w: World):
    c = w.view("fx_coaches")

    def payload(df, coach, head):
        return df.groupBy("train_id").agg(F.sort_array(F.collect_list(coach)).alias("a")).select(F.to_json(head).alias("value"))

    num = F.col("ord").cast("string")
    de = payload(c.where("train_id % 3 = 0"), F.struct(
        num.alias("wagenordnungsnummer"), F.when(F.col("class") != "N", F.col("class")).alias("klasse"), F.when(F.col("class") != "N", "C").alias("sektor"),
        (F.col("ord") * 5.0).alias("startProzent"), (F.col("ord") * 5.0 + 5).alias("endeProzent")),
        F.struct(F.struct(F.col("train_id").cast("string").alias("trainNumber"), F.lit(200.0).alias("platformLengthM")).alias("meta"), F.col("a").alias("wagons")))
    ch = payload(c.where("train_id % 3 = 1"), F.struct(
        F.col("ord").alias("ordNo"), F.array(F.struct(F.when(F.col("ord") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("sectors"))).alias("stops")),
        F.struct(F.struct(F.col("train_id").cast("string").alias("operationalNumber")).alias("train"), F.col("a").alias("vehicles")))
    fr = payload(c.where("train_id % 3 = 2"), F.struct(num.alias("numero"), F.col("ord").alias("rang")),
                 F.struct(F.col("train_id").cast("string").alias("train"), F.col("a").alias("voitures")))
    rows = feeds.coaches_from_feed(de, "DE").unionByName(feeds.coaches_from_feed(ch, "CH")).unionByName(feeds.coaches_from_feed(fr, "FR"))
    return rows.select("train_id", "country", "coach", "ord", F.array_join("sectors", ",").alias("sectors"), "start_m", "end_m")


def formation(coaches, coach, head):
    """One payload a train, its coaches in order."""
    return coaches.groupBy("train_id").agg(F.sort_array(F.collect_list(coach)).alias("a")).select(F.to_json(head).alias("value"))


@query("coach_feeds_numbered", "O-11", """
SELECT CAST(train_id AS VARCHAR) AS train_id, CASE train_id%3 WHEN 0 THEN 'AT' WHEN 1 THEN 'NL' ELSE 'GB' END AS country,
  CASE WHEN train_id%3=0 THEN 'W'||CAST(ord AS VARCHAR) WHEN train_id%3=2 THEN CAST(ord AS VARCHAR) WHEN ord%3=0 THEN CAST(n AS VARCHAR) ELSE 'M'||CAST(ord AS VARCHAR) END AS coach,
  CAST(CASE WHEN ord%2=0 THEN ord+10 ELSE n END AS INT) AS ord, CASE WHEN train_id%3<>2 THEN class WHEN class='A' THEN '1' ELSE '2' END AS class,
  CASE WHEN train_id%3<>1 AND class='A' THEN 'A' ELSE '' END AS sectors, CASE WHEN train_id%3=0 THEN 'G'||class END AS grp, train_id%3=0 AND train_id%2=0 AS reversed
FROM (SELECT *, row_number() OVER (PARTITION BY train_id ORDER BY ord) AS n FROM {fx_coaches}) c""")
def coach_feeds_numbered(w: World):
    c = w.view("fx_coaches")
    num, train = F.col("ord").cast("string"), F.col("train_id").cast("string")
    place, sector = F.when(F.col("ord") % 2 == 0, F.col("ord") + 10), F.when(F.col("class") == "A", "A").otherwise("")
    at = formation(c.where("train_id % 3 = 0"), F.struct("ord", F.concat(F.lit("W"), num).alias("nummer"), place.alias("reihung"), F.col("class").alias("klasse"),
                   sector.alias("sektor"), F.concat(F.lit("G"), "class").alias("zugteil")),
                   F.struct(train.alias("zugnummer"), F.when(F.col("train_id") % 2 == 0, True).alias("reversed"), F.col("a").alias("wagen")))
    nl = formation(c.where("train_id % 3 = 1"), F.struct("ord", F.when(F.col("ord") % 3 != 0, F.concat(F.lit("M"), num)).alias("materieelnummer"), place.alias("volgorde"), F.col("class").alias("klasse")),
                   F.struct(train.alias("ritnummer"), F.col("a").alias("materieeldelen")))
    # `ord` only sorts the list; the GB feed names the place `order`
    gb = formation(c.where("train_id % 3 = 2"), F.struct("ord", num.alias("coachNumber"), place.alias("order"), F.when(F.col("class") == "A", "First Class").otherwise("Standard").alias("coachClass"),
                   sector.alias("sector")), F.struct(F.when(F.col("train_id") % 2 == 0, train).alias("trainId"), train.alias("rid"), F.col("a").alias("coaches")))
    rows = feeds.coaches_from_feed(at, "AT").unionByName(feeds.coaches_from_feed(nl, "NL")).unionByName(feeds.coaches_from_feed(gb, "GB"))
    return rows.select("train_id", "country", "coach", "ord", "class", F.array_join("sectors", ",").alias("sectors"), "grp", "reversed")


@query("actual_formations", "O-11", """
SELECT CAST(train_id AS VARCHAR) AS train_id, CAST(ord AS VARCHAR) AS coach, ord, CASE class WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE 'WR' END AS class, CASE WHEN class='A' THEN 'A' ELSE '' END AS sectors,
  CASE WHEN ord%2=0 THEN ord*10.5e0 ELSE (ord*5e0)/100*240 END AS start_m, CASE WHEN ord%2=0 THEN ord*10.5e0+len_m ELSE (ord*5e0+4)/100*240 END AS end_m, 'Z'||CAST(train_id AS VARCHAR) AS grp
FROM {fx_coaches} WHERE NOT (class='N' AND ord%2=0)""")
def actual_formations(w: World):
    num, even = F.col("ord").cast("string"), F.col("ord") % 2 == 0
    kind = F.when(F.col("class") == "A", "REISEZUGWAGENERSTEKLASSE").when(F.col("class") == "R", "REISEZUGWAGENZWEITEKLASSE").when(even, "TRIEBKOPF").otherwise("SPEISEWAGEN")
    at = F.struct(
        F.when(even, (F.col("ord") * 10.5).cast("string")).alias("startmeter"), F.when(even, (F.col("ord") * 10.5 + F.col("len_m")).cast("string")).alias("endemeter"),
        F.when(~even, (F.col("ord") * 5.0).cast("string")).alias("startprozent"), F.when(~even, (F.col("ord") * 5.0 + 4).cast("string")).alias("endeprozent"))
    coach = F.struct("ord", num.alias("wagenordnungsnummer"), kind.alias("kategorie"), F.when(F.col("class") == "A", "A").otherwise("").alias("fahrzeugsektor"), at.alias("positionamhalt"))
    ends = [F.struct(F.lit(s).alias("sektorbezeichnung"), F.struct(F.lit(e).alias("endemeter")).alias("positionamgleis")) for s, e in (("A", "100.0"), ("B", "240.0"))]
    train = F.col("train_id").cast("string")
    group = F.struct(F.lit("").alias("fahrzeuggruppebezeichnung"), F.concat(F.lit("Z"), train).alias("verkehrlichezugnummer"), F.col("a").alias("allFahrzeug"))
    head = F.struct(F.struct(F.struct(train.alias("fahrtnummer"), F.array(group).alias("allFahrzeuggruppe"), F.array(*ends).alias("allSektor")).alias("istformation")).alias("data"))
    rows = feeds.coaches_from_actual(formation(w.view("fx_coaches"), coach, head))
    return rows.select("train_id", "coach", "ord", "class", F.array_join("sectors", ",").alias("sectors"), "start_m", "end_m", "grp")


@query("refreshed_updates", "O-114", """
SELECT CAST(journey_id AS VARCHAR)||'/0' AS journey_id, CAST(n AS INT) AS change_no, CAST(arr_late AS DOUBLE) AS inbound_s, CAST(CASE WHEN lead(bad_time) OVER q THEN 0 ELSE lead(dep_late) OVER q END AS DOUBLE) AS outbound_s,
  arr_platform AS arr_track_now, lead(dep_platform) OVER q AS dep_track_now, cancelled OR lead(cancelled) OVER q AS cancelled
FROM {o_leg} WHERE mode<>'walking' WINDOW q AS (PARTITION BY journey_id ORDER BY leg_no) QUALIFY lead(leg_no) OVER q IS NOT NULL""")
def refreshed_updates(w: World):
    return feeds.updates_from_plans(plans(w))


@query("poi_load", "O-13", """
SELECT id, category, subtype, nullif(name,'') AS name, round(lat,6) AS lat, round(lon,6) AS lon FROM {fx_pois} WHERE subtype<>'bench'
UNION ALL SELECT -w.way_id, 'shop', 'mall', NULL, round(avg(n.lat),6), round(avg(n.lon),6) FROM {fx_ways} w JOIN {fx_way_nodes} wn USING (way_id) JOIN {fx_nodes} n ON n.id=wn.node_id WHERE w.area='yes' GROUP BY w.way_id""")
def poi_load(w: World):
    p = w.view("fx_pois")
    tags = F.map_filter(F.create_map(
        F.when(F.col("category") == "shop", "shop").otherwise("amenity"), F.col("subtype"), F.lit("name"), F.col("name")), lambda k, v: v != "")
    nodes = p.select("id", "lat", "lon", tags.alias("tags"))
    areas = w.ways.where(tg.tag("tags", "area") == "yes").select("id", "nodes", F.create_map(F.lit("shop"), F.lit("mall")).alias("tags"))
    # area vertices come from the map, POI nodes from the extract
    out = feeds.load_pois(nodes, areas.where("false")).unionByName(feeds.load_pois(w.nodes.select("id", "lat", "lon", F.expr("cast(map() as map<string,string>)").alias("tags")), areas))
    return out.select("id", "category", "subtype", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def result_lines(w: World):
    """Survey results as text lines; a killed writer tore some."""
    line = F.to_json(F.struct(F.col("event_id").alias("rid"), F.lit("ok").alias("status"), F.lit(3).alias("pairs"), F.col("value").alias("elapsed_s")))
    return w.table("events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 6)).otherwise(line).alias("value"))


@query("torn_results", "O-15", "SELECT count(*) FILTER (event_id%7<>0) AS good, count(*) FILTER (event_id%7=0) AS torn FROM {events}")
def torn_results(w: World):
    return feeds.parse_results(result_lines(w)).agg(F.count_if(~F.col("torn")).alias("good"), F.count_if("torn").alias("torn"))


@query("result_files", "O-15", """
SELECT CASE WHEN event_id%7=0 THEN 'torn' ELSE 'good' END AS part, count(*) AS n FROM {events} GROUP BY 1""")
def result_files(w: World):
    path = new_folder(w, "results")
    result_lines(w).write.text(path)
    good, torn = feeds.read_results(w.spark, path)
    parts = good.select(F.lit("good").alias("part")).unionByName(torn.select(F.lit("torn").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("atomic_rebuild", "O-16", "SELECT node_id, ref FROM (SELECT id AS node_id, ref FROM {fx_nodes} WHERE (railway='stop' OR public_transport='stop_position') AND ref<>'' AND NOT (bus='yes' AND railway<>'stop')) t")
def atomic_rebuild(w: World):
    from footbridge.operators.ways import station_stops

    path = new_folder(w, "table")
    feeds.rebuild(station_stops(w.nodes).where("false"), path)
    feeds.rebuild(station_stops(w.nodes), path)
    return feeds.current(w.spark, path).select("node_id", "ref")


OVERLAY_SQL = """
SELECT station, string_agg(track, ',' ORDER BY length(track), track) AS tracks FROM {fx_overlay} GROUP BY station"""


def tracks_of(docs):
    tracks = F.from_json("document", "struct<platforms:array<struct<track:string>>>")["platforms"]
    return docs.select("station", F.array_join(F.transform(tracks, lambda t: t["track"]), ",").alias("tracks"))


@query("overlay_documents", "O-17", OVERLAY_SQL)
def overlay_documents(w: World):
    return tracks_of(feeds.overlay_documents(w.view("fx_overlay")))


@query("overlay_files", "O-17", OVERLAY_SQL)
def overlay_files(w: World):
    path = new_folder(w, "overlay")
    feeds.write_overlay(w.view("fx_overlay"), path)
    return tracks_of(w.spark.read.schema("station string, document string").json(path))
