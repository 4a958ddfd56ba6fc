"""Readers of operator and planner feeds, and the overlay and rebuild sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.text import plausible_track
from footbridge.functions.times import delay, instant, seconds_between

# ---- transit stops ------------------------------------------------------------------

def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """A timetable feed's stop table; every column stays text."""
    return spark.read.csv(path, header=True)


def feed_platforms(stops: DataFrame) -> DataFrame:
    """Stops with a plausible platform code, named after their parent station."""
    parents = stops.where(F.trim(F.coalesce("location_type", F.lit("0"))) == "1").select(
        F.trim("stop_id").alias("parent_id"), F.nullif(F.trim("stop_name"), F.lit("")).alias("parent_name"))
    kept = stops.withColumns({"lat": tg.number(F.col("stop_lat")), "lon": tg.number(F.col("stop_lon"))}).where(
        plausible_track(F.col("platform_code")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return kept.join(parents, F.trim("parent_station") == F.col("parent_id"), "left").select(
        "stop_id", F.coalesce("parent_name", F.trim(F.coalesce("stop_name", F.lit("")))).alias("station"),
        F.trim("platform_code").alias("code"), "lat", "lon")


# ---- stop places --------------------------------------------------------------------
_LIMITS = "struct<limitations:struct<AccessibilityLimitation:struct<StepFreeAccess:string,WheelchairAccess:string>>>"
_POINT = "struct<Location:struct<Latitude:string,Longitude:string>>"
_PLACE = f"struct<Centroid:{_POINT},placeEquipments:struct<LiftEquipmentRef:string>,LiftEquipmentRef:string>"
STOP_PLACE = (
    "_id string, Name string, ParentSiteRef struct<_ref:string>, keyList struct<KeyValue:array<struct<Key:string,Value:string>>>, "
    f"AccessibilityAssessment {_LIMITS}, quays struct<Quay:array<struct<Name:string,Centroid:{_POINT},AccessibilityAssessment:{_LIMITS},"
    f"equipmentPlaces:struct<EquipmentPlace:array<{_PLACE}>>,LiftEquipmentRef:string>>>"
)


def read_stop_places(spark: SparkSession, path: str) -> DataFrame:
    """Stop places of an XML file, one row each; the file is split by its row tag."""
    return spark.read.format("xml").option("rowTag", "StopPlace").schema(STOP_PLACE).load(path)


def stop_quays(places: DataFrame) -> DataFrame:
    """Track-labelled, located quays of each stop place, the first per label.

    A quay without its own coordinate takes the mean of its equipment; one without its own access
    rating takes the place's. Unknown stays null.
    """
    def tri(c: Column) -> Column:
        return F.when(c == "true", True).when(c == "false", False)

    place = places.select(
        F.coalesce(F.regexp_replace(F.nullif(F.col("ParentSiteRef._ref"), F.lit("")), "^[a-z0-9]+:", ""),
                   F.regexp_replace(F.regexp_replace(F.coalesce("_id", F.lit("")), "^[a-z0-9]+:", ""), ":[A-Za-z][A-Za-z0-9]*$", "")).alias("station_key"),
        F.col("Name").alias("name"),
        F.expr("get(filter(keyList.KeyValue, k -> k.Key = 'EVA'), 0).Value").alias("eva"),
        tri(F.col("AccessibilityAssessment.limitations.AccessibilityLimitation.StepFreeAccess")).alias("p_free"),
        tri(F.col("AccessibilityAssessment.limitations.AccessibilityLimitation.WheelchairAccess")).alias("p_wheel"),
        F.posexplode("quays.Quay").alias("seq", "q"))
    gear = F.transform(F.coalesce("q.equipmentPlaces.EquipmentPlace", F.array()), lambda e: F.struct(
        tg.number(e["Centroid"]["Location"]["Latitude"]).alias("lat"), tg.number(e["Centroid"]["Location"]["Longitude"]).alias("lon")))
    spots = F.filter(gear, lambda s: s["lat"].isNotNull() & s["lon"].isNotNull())

    def mean(axis: str) -> Column:
        total = F.aggregate(spots, F.lit(0.0), lambda a, s: a + s[axis])
        return F.when(F.size(spots) > 0, total / F.size(spots))

    own_lat = tg.number(F.col("q.Centroid.Location.Latitude"))
    own_lon = tg.number(F.col("q.Centroid.Location.Longitude"))
    own = own_lat.isNotNull() & own_lon.isNotNull()
    limit = "q.AccessibilityAssessment.limitations.AccessibilityLimitation"
    lifts = F.exists(F.coalesce("q.equipmentPlaces.EquipmentPlace", F.array()), lambda e: F.coalesce(
        e["placeEquipments"]["LiftEquipmentRef"], e["LiftEquipmentRef"]).isNotNull())
    rows = place.select(
        "station_key", "name", "eva", "seq",
        F.regexp_replace(F.nullif(F.regexp_extract(F.coalesce("q.Name", F.lit("")), M.QUAY_LABEL, 1), F.lit("")), r"\s+", "").alias("public_label"),
        F.when(own, own_lat).otherwise(mean("lat")).alias("lat"), F.when(own, own_lon).otherwise(mean("lon")).alias("lon"),
        F.coalesce(tri(F.col(f"{limit}.StepFreeAccess")), "p_free").alias("step_free"),
        F.coalesce(tri(F.col(f"{limit}.WheelchairAccess")), "p_wheel").alias("wheelchair"),
        (lifts | F.col("q.LiftEquipmentRef").isNotNull()).alias("has_lift"))
    kept = rows.where("public_label is not null and lat is not null and lon is not null")
    return kept.groupBy("station_key", "name", "eva", "public_label").agg(F.min_by(F.struct(
        "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "step_free", "wheelchair", "has_lift"), "seq").alias("q")).select(
        "station_key", "name", "eva", "public_label", "q.*")


def merge_quays(quays: DataFrame) -> DataFrame:
    """One overlay over all stop places of a station: the first quay per label, the centre redone.

    ``quays`` has the columns of ``stop_quays`` with ``seq`` in reading order over the whole feed.
    """
    fields = ["lat", "lon", "step_free", "wheelchair", "has_lift"]
    first = quays.groupBy("station_key", "public_label").agg(F.min_by(F.struct(*fields), "seq").alias("q")).select("station_key", "public_label", "q.*")
    centre = first.groupBy("station_key").agg(F.round(F.avg("lat"), 7).alias("st_lat"), F.round(F.avg("lon"), 7).alias("st_lon"))
    names = quays.groupBy("station_key").agg(
        F.min_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("seq"))).alias("name"), F.min_by("eva", "seq").alias("eva"))
    return first.join(centre, "station_key").join(names, "station_key")


# ---- plans --------------------------------------------------------------------------
_STOP = ("struct<name:string,stopId:string,lat:double,lon:double,track:string,scheduledTrack:string,arrival:string,"
         "scheduledArrival:string,departure:string,scheduledDeparture:string,cancelled:boolean>")
PLAN = (
    "struct<itineraries:array<struct<duration:bigint,transfers:int,legs:array<struct<mode:string,displayName:string,routeShortName:string,headsign:string,"
    "startTime:string,scheduledStartTime:string,endTime:string,scheduledEndTime:string,distance:double,duration:double,cancelled:boolean,"
    f"`from`:{_STOP},`to`:{_STOP},intermediateStops:array<{_STOP}>>>>>>"
)


def parse_plans(raw: DataFrame, column: str = "value") -> DataFrame:
    """Planner answers as text (``plan_id`` and a JSON column) to the typed ``plan``."""
    return raw.select("plan_id", F.from_json(column, PLAN).alias("plan"))


def legs_from_plans(plans: DataFrame) -> DataFrame:
    """Every leg of every itinerary; any walking or cycling mode is ``walking``."""
    its = plans.select("plan_id", F.posexplode("plan.itineraries").alias("itinerary", "i"))
    legs = its.select("plan_id", "itinerary", F.col("i.duration").alias("given_s"), F.col("i.transfers").alias("transfers"),
                      F.posexplode("i.legs").alias("leg_no", "l"), F.get(F.col("i.legs"), F.lit(0))["startTime"].alias("first_dep"),
                      F.element_at("i.legs", -1)["endTime"].alias("last_arr"))
    walk = F.coalesce(F.col("l.mode").isin(*M.WALK_MODES), F.lit(False))
    return legs.select(
        "plan_id", "itinerary", "leg_no", F.when(walk, "walking").otherwise(F.lower(F.coalesce("l.mode", F.lit("")))).alias("mode"),
        F.when(~walk, F.coalesce(F.nullif("l.displayName", F.lit("")), F.col("l.routeShortName"))).alias("train_name"),
        F.col("l.from.name").alias("origin"), F.col("l.to.name").alias("destination"),
        F.col("l.from.lat").alias("dep_lat"), F.col("l.from.lon").alias("dep_lon"), F.col("l.to.lat").alias("arr_lat"), F.col("l.to.lon").alias("arr_lon"),
        F.col("l.from.track").alias("dep_platform"), F.col("l.to.track").alias("arr_platform"),
        F.col("l.startTime").alias("dep_time"), F.col("l.endTime").alias("arr_time"),
        delay(F.col("l.startTime"), F.col("l.scheduledStartTime")).alias("dep_delay_s"),
        delay(F.col("l.endTime"), F.col("l.scheduledEndTime")).alias("arr_delay_s"),
        F.when(walk, F.col("l.distance").cast("int")).alias("distance_m"), F.coalesce("l.cancelled", F.lit(False)).alias("cancelled"),
        F.coalesce("given_s", seconds_between(instant(F.col("first_dep")), instant(F.col("last_arr"))).cast("long")).alias("duration_s"),
        F.coalesce("transfers", F.lit(0)).alias("num_changes"))


def stopovers(plans: DataFrame) -> DataFrame:
    """Intermediate stops of each leg with their delays."""
    its = plans.select("plan_id", F.posexplode("plan.itineraries").alias("itinerary", "i"))
    legs = its.select("plan_id", "itinerary", F.posexplode("i.legs").alias("leg_no", "l"))
    stops = legs.select("plan_id", "itinerary", "leg_no", F.posexplode("l.intermediateStops").alias("stop_no", "s"))
    return stops.select(
        "plan_id", "itinerary", "leg_no", "stop_no", F.col("s.name").alias("station"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon"),
        F.col("s.track").alias("track"), delay(F.col("s.arrival"), F.col("s.scheduledArrival")).alias("arr_delay_s"),
        delay(F.col("s.departure"), F.col("s.scheduledDeparture")).alias("dep_delay_s"), F.coalesce("s.cancelled", F.lit(False)).alias("cancelled"))


def updates_from_plans(plans: DataFrame) -> DataFrame:
    """The live state of each change of a refreshed itinerary: delays and current tracks."""
    from footbridge.operators.journeys import interchanges

    legs = legs_from_plans(plans).withColumns({
        "journey_id": F.concat_ws("/", "plan_id", "itinerary"), "arr_late": F.coalesce("arr_delay_s", F.lit(0)),
        "dep_late": F.coalesce("dep_delay_s", F.lit(0))})
    return interchanges(legs).select(
        "journey_id", "change_no", F.col("arr_late").cast("double").alias("inbound_s"), F.col("dep_late").cast("double").alias("outbound_s"),
        F.col("arr_platform").alias("arr_track_now"), F.col("dep_platform").alias("dep_track_now"), (F.col("arr_cancelled") | F.col("dep_cancelled")).alias("cancelled"))


# ---- boards and formations -------------------------------------------------------------
BOARD = ("struct<departures:array<struct<train:string,trainNumber:string,trainClasses:array<string>,scheduledDeparture:string,delayDeparture:int,"
         "platform:string,scheduledPlatform:string,destination:string,route:array<struct<name:string>>,isCancelled:boolean>>>")


def departures(boards: DataFrame, column: str = "value") -> DataFrame:
    """Station boards (``hub`` and a JSON column) to one row per departure."""
    rows = boards.select("hub", F.posexplode(F.from_json(column, BOARD)["departures"]).alias("seq", "d"))
    return rows.select(
        "hub", "seq", F.coalesce("d.train", F.lit("")).alias("train"), F.coalesce("d.trainNumber", F.lit("")).alias("train_number"),
        F.coalesce(F.get(F.col("d.trainClasses"), F.lit(0)), F.lit("")).alias("train_class"), F.col("d.scheduledDeparture").alias("scheduled"),
        F.col("d.delayDeparture").alias("delay_min"), F.col("d.platform").alias("platform"), F.col("d.scheduledPlatform").alias("planned_platform"),
        F.col("d.destination").alias("destination"), F.size(F.coalesce("d.route", F.array())).alias("n_stops"), F.coalesce("d.isCancelled", F.lit(False)).alias("cancelled"))


def long_distance(rows: DataFrame) -> DataFrame:
    """Departures that may have a coach formation."""
    return rows.where("train_class = 'F' and coalesce(scheduled, '') <> ''")


# operator -> the coach array of its payload and where each fact sits (null: not in the feed)
FORMATIONS = {
    "DE": ("struct<meta:struct<trainNumber:string,platformLengthM:double>,wagons:array<struct<wagenordnungsnummer:string,klasse:string,sektor:string,startMeter:double,"
           "endeMeter:double,startProzent:double,endeProzent:double,zugteil:string>>>",
           "p.meta.trainNumber", "p.wagons", dict(
               coach="c.wagenordnungsnummer", ord="if(c.wagenordnungsnummer rlike '^[0-9]+$', int(c.wagenordnungsnummer), null)", cls="c.klasse",
               sectors="if(coalesce(c.sektor, '') <> '', array(c.sektor), array())", start="coalesce(c.startMeter, c.startProzent / 100 * p.meta.platformLengthM)",
               end="if(c.startMeter is null and c.startProzent is not null, c.endeProzent / 100 * p.meta.platformLengthM, c.endeMeter)", grp="c.zugteil",
               keep="c.klasse is not null or coalesce(c.sektor, '') <> ''", reversed="false")),
    "CH": ("struct<train:struct<operationalNumber:string>,vehicles:array<struct<label:string,ordNo:int,classCI:string,groupNo:string,stops:array<struct<sectors:array<string>>>>>>",
           "p.train.operationalNumber", "p.vehicles", dict(
               coach="coalesce(c.label, string(c.ordNo))", ord="c.ordNo", cls="if(c.classCI in ('1', '2', '12', 'WR'), c.classCI, null)",
               sectors="coalesce(get(c.stops, 0).sectors, array())", start="double(null)", end="double(null)", grp="c.groupNo", keep="true", reversed="false")),
    "AT": ("struct<zugnummer:string,reversed:boolean,wagen:array<struct<nummer:string,reihung:int,klasse:string,sektor:string,zugteil:string>>>",
           "p.zugnummer", "p.wagen", dict(
               coach="c.nummer", ord="coalesce(c.reihung, pos + 1)", cls="c.klasse", sectors="if(coalesce(c.sektor, '') <> '', array(c.sektor), array())",
               start="double(null)", end="double(null)", grp="c.zugteil", keep="true", reversed="coalesce(p.reversed, false)")),
    "NL": ("struct<ritnummer:string,materieeldelen:array<struct<materieelnummer:string,volgorde:int,klasse:string>>>",
           "p.ritnummer", "p.materieeldelen", dict(
               coach="coalesce(c.materieelnummer, string(pos + 1))", ord="coalesce(c.volgorde, pos + 1)", cls="c.klasse", sectors="cast(array() as array<string>)",
               start="double(null)", end="double(null)", grp="string(null)", keep="true", reversed="false")),
    "FR": ("struct<train:string,sensInverse:boolean,voitures:array<struct<numero:string,rang:int,classe:string>>>",
           "p.train", "p.voitures", dict(
               coach="c.numero", ord="coalesce(c.rang, pos + 1)", cls="c.classe", sectors="cast(array() as array<string>)", start="double(null)", end="double(null)",
               grp="string(null)", keep="true", reversed="coalesce(p.sensInverse, false)")),
    "GB": ("struct<trainId:string,rid:string,coaches:array<struct<coachNumber:string,`order`:int,coachClass:string,sector:string>>>",
           "coalesce(p.trainId, p.rid)", "p.coaches", dict(
               coach="c.coachNumber", ord="coalesce(c.`order`, pos + 1)", cls="if(lower(coalesce(c.coachClass, '')) like 'first%', '1', '2')",
               sectors="if(coalesce(c.sector, '') <> '', array(c.sector), array())", start="double(null)", end="double(null)", grp="string(null)", keep="true", reversed="false")),
}


def coaches_from_feed(payloads: DataFrame, operator: str, column: str = "value") -> DataFrame:
    """One operator's formation payloads to coaches; vehicles nobody boards are dropped."""
    schema, train, array, at = FORMATIONS[operator]
    rows = payloads.select(F.from_json(column, schema).alias("p")).select("p", F.posexplode(F.expr(array)).alias("pos", "c")).where(at["keep"])
    return rows.selectExpr(
        f"{train} as train_id", f"'{operator}' as country", f"{at['coach']} as coach", f"int({at['ord']}) as ord", f"{at['cls']} as class",
        f"cast({at['sectors']} as array<string>) as sectors", f"double({at['start']}) as start_m", f"double({at['end']}) as end_m", f"{at['grp']} as grp", f"{at['reversed']} as reversed")


ACTUAL_FORMATION = (
    "struct<data:struct<istformation:struct<fahrtnummer:string,allFahrzeuggruppe:array<struct<fahrzeuggruppebezeichnung:string,verkehrlichezugnummer:string,"
    "allFahrzeug:array<struct<wagenordnungsnummer:string,kategorie:string,fahrzeugsektor:string,positionamhalt:struct<startmeter:string,endemeter:string,startprozent:string,endeprozent:string>>>>>,"
    "allSektor:array<struct<sektorbezeichnung:string,positionamgleis:struct<startmeter:string,endemeter:string>>>>>>")


def coaches_from_actual(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Actual-formation payloads to coaches: power cars dropped, percent turned into metres."""
    ist = payloads.select(F.from_json(column, ACTUAL_FORMATION)["data"]["istformation"].alias("f"))
    ends = F.transform(F.coalesce("f.allSektor", F.array()), lambda s: tg.number(s["positionamgleis"]["endemeter"]))
    groups = ist.withColumn("length_m", F.array_max(ends)).select("f.fahrtnummer", "length_m", F.explode("f.allFahrzeuggruppe").alias("g"))
    cars = groups.select("fahrtnummer", "length_m", F.coalesce(F.nullif("g.fahrzeuggruppebezeichnung", F.lit("")), "g.verkehrlichezugnummer").alias("grp"), F.explode("g.allFahrzeug").alias("c"))
    kind = F.upper(F.coalesce("c.kategorie", F.lit("")))
    classes = F.create_map(*[F.lit(x) for kv in M.COACH_CLASSES.items() for x in kv])
    start, end = tg.number(F.col("c.positionamhalt.startmeter")), tg.number(F.col("c.positionamhalt.endemeter"))
    p0, p1 = tg.number(F.col("c.positionamhalt.startprozent")), tg.number(F.col("c.positionamhalt.endeprozent"))
    boardable = F.lit(True)
    for word in M.UNBOARDABLE:
        boardable = boardable & ~kind.contains(word)
    num = F.col("c.wagenordnungsnummer")
    return cars.where(boardable).select(
        F.col("fahrtnummer").alias("train_id"), F.lit("DE").alias("country"), num.alias("coach"), F.when(num.rlike("^[0-9]+$"), num.cast("int")).alias("ord"),
        F.try_element_at(classes, kind).alias("class"),
        F.when(F.coalesce("c.fahrzeugsektor", F.lit("")) != "", F.array("c.fahrzeugsektor")).otherwise(F.array().cast("array<string>")).alias("sectors"),
        F.coalesce(start, p0 / 100 * F.col("length_m")).alias("start_m"),
        F.when(start.isNull() & p0.isNotNull() & F.col("length_m").isNotNull(), p1 / 100 * F.col("length_m")).otherwise(end).alias("end_m"),
        "grp", F.lit(False).alias("reversed"))


# ---- points of interest ----------------------------------------------------------------

def load_pois(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """POI nodes and area centroids with the first category key present; furniture left out.

    Areas get the negated way id and buildings are skipped; a way's centre is the mean of its vertices.
    """
    from footbridge.operators.graph import way_points

    category = F.coalesce(*[F.when(tg.has_tag("tags", c), F.lit(c)) for c in M.POI_CATEGORIES])
    subtype = F.coalesce(*[tg.tag("tags", c) for c in M.POI_CATEGORIES])

    def kept(df: DataFrame) -> DataFrame:
        return df.withColumns({"category": category, "subtype": subtype}).where(
            F.col("category").isNotNull() & ~((F.col("category") == "amenity") & F.col("subtype").isin(*M.AMENITY_NOISE)))

    fields = ["category", "subtype", tg.tag("tags", "name").alias("name"), tg.tag("tags", "level").alias("level")]
    spots = kept(nodes.where("lat is not null and lon is not null")).select("id", *fields, "lat", "lon")
    areas = kept(ways.where(~tg.has_tag("tags", "building")))
    centre = way_points(areas, nodes).groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    shapes = areas.select(F.col("id").alias("way_id"), *fields).join(centre, "way_id").select(
        (-F.col("way_id")).alias("id"), "category", "subtype", "name", "level", "lat", "lon")
    return spots.unionByName(shapes).dropDuplicates(["id"])


# ---- results, rebuilds and overlays -------------------------------------------------------
RESULT = ("rid bigint, status string, platform_count int, sampled boolean, pairs bigint, connected bigint, stitchable bigint, island bigint, elapsed_s double, _torn string")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Survey result lines; rows torn by a killed writer are returned apart, never fatal."""
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").schema(RESULT).json(path)
    return rows.where("_torn is null and rid is not null").drop("_torn"), rows.where("_torn is not null or rid is null").select("_torn")


def parse_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same for a text column: one row per line, ``torn`` marks the unreadable ones."""
    parsed = lines.select(F.from_json(column, RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return parsed.select("r.*").withColumn("torn", F.col("_torn").isNotNull() | F.col("rid").isNull()).drop("_torn")


def rebuild(df: DataFrame, path: str) -> str:
    """Replace a derived table whole: write a new version, then publish it in the pointer table.

    Readers follow the newest pointer, so they see the old version or the new one, never a mix.
    """
    version = f"{path}/versions/{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published")).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table written by ``rebuild``."""
    newest = spark.read.schema("version string, published timestamp").json(f"{path}/pointer").agg(F.max_by("version", "published").alias("v")).first()["v"]
    return spark.read.parquet(newest)


def overlay_documents(overlay: DataFrame) -> DataFrame:
    """One JSON document per station, tracks ordered by length and then text.

    A station has a few dozen tracks; the document is the output value itself.
    """
    entry = F.struct(F.length("track").alias("n"), "track", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return overlay.groupBy("station").agg(
        F.min("st_lat").alias("st_lat"), F.min("st_lon").alias("st_lon"), F.sort_array(F.collect_list(entry)).alias("t")).select(
        "station", F.to_json(F.struct(F.col("st_lat").alias("lat"), F.col("st_lon").alias("lon"), F.transform(
            "t", lambda e: F.struct(e["track"].alias("track"), e["lat"].alias("lat"), e["lon"].alias("lon"))).alias("platforms"))).alias("document"))


def write_overlay(overlay: DataFrame, path: str) -> None:
    overlay_documents(overlay).write.mode("overwrite").json(path)
