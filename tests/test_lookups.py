"""Lookups of stations, stops and names whose joins must not grow with the square of the table."""

from pyspark.sql import functions as F

from footbridge.functions.geo import haversine
from footbridge.operators import platforms, search, spatial


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_station_candidates_repeat_the_stations_only(spark):
    queries = spark.createDataFrame([(q, 47.0 + q * 0.001 + k * 0.002, 8.0) for q in range(12) for k in (0, 1)] + [(99, None, 8.0), (98, 47.0, -179.9999)], "query_id long, lat double, lon double")
    stations = spark.createDataFrame([(s, f"H{s}", 47.0 + s * 0.0015, 8.0) for s in range(9)] + [(50, "W", 47.0, 179.9999), (51, "N", None, None)], "relation_id long, name string, lat double, lon double")
    out = spatial.station_candidates(queries, stations, 600.0, 3)
    # what is repeated for neighbour cells is the side of the stations
    assert plan_of(out).split("Generate explode")[1].split("LogicalRDD [")[1].startswith("relation_id")
    near = queries.crossJoin(stations.withColumnsRenamed({"lat": "b", "lon": "c"})).withColumn("d", haversine("lat", "lon", "b", "c")).where("d <= 600")
    best = {}
    for r in near.groupBy("query_id", "relation_id").agg(F.min("d").alias("d")).collect():
        best.setdefault(r.query_id, []).append((round(r.d, 3), r.relation_id))
    want = {(q, rel, k + 1) for q, rows in best.items() for k, (_, rel) in enumerate(sorted(rows)[:3])}
    assert {(r.query_id, r.relation_id, r["rank"]) for r in out.collect()} == want and (98, 50, 1) in want


def test_stops_meet_the_boxes_that_hold_them_and_no_others(spark):
    boxes = spark.createDataFrame([(i, 47.0 + i, 47.01 + i, 8.0, 8.01) for i in range(5)], "relation_id long, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    stops = spark.createDataFrame([("6", 100 + i, 47.005 + i, 8.005) for i in range(5)] + [("6", 90, 47.001, 8.001), ("7", 91, 47.005, 8.005), (None, 92, 47.005, 8.005), ("6", 93, None, None)], "ref string, node_id long, lat double, lon double")
    nodes = spark.createDataFrame([(200 + i, 47.00501 + i, 8.005) for i in range(5)], "id long, lat double, lon double").withColumn("tags", F.expr("cast(map() as map<string,string>)"))
    ways = spark.createDataFrame([(300 + i, [200 + i]) for i in range(5)], "id long, nodes array<long>").withColumn("tags", F.create_map(F.lit("highway"), F.lit("footway")))
    misses = spark.createDataFrame([(i, r) for i in range(4) for r in ("6", "7")] + [(0, "6"), (0, None)], "relation_id long, ref string")
    out = platforms.resolve_by_stop(misses, boxes, stops, ways, nodes)
    got = {(r.relation_id, r.ref, r.anchor, r.way_id) for r in out.collect()}
    assert got == {(i, "6", 200 + i, 300 + i) for i in range(4)} | {(0, "7", 200, 300)}
    # a join on the ref alone meets each stop with every box
    assert "Join Inner, (ref" not in plan_of(out)


def test_names_are_looked_up_once(spark):
    keys = spark.createDataFrame([(1, "bern", "bern", True), (2, "berneck", "berneck", False)], "idx long, key string, own_key string, is_main boolean")
    terms = spark.createDataFrame([("Bern",), ("berne",), ("eck",), ("none",), ("Bern",)], "term string")
    out = search.resolve_names(terms, keys)
    assert {tuple(r) for r in out.collect()} == {("Bern", 1, "exact"), ("berne", 2, "search"), ("eck", 2, "search")}
    # the exact hits are read back, so the join with the keys is not made again
    assert plan_of(out).split("Union")[1].lstrip(" \n:false,+-").startswith("Relation")
