"""Small rules: levels, refs, labels, verdicts, surveys, spatial edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.text import fold_key, fold_name, hub_tokens, plausible_track, track_ref
from footbridge.operators import delays, heights, journeys, linkage, platforms, spatial, surveys, walks
from footbridge.sources import feeds


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_levels(spark):
    got = column(spark, ["1", "-2;-1;0", "-3-0", "0.5", "-0.5", None, "", "ground", "1;x", "1--2", "1e-3", ";1;", " 2 "], tg.parse_levels)
    assert got == [[1.0], [-2.0, -1.0, 0.0], [-3.0, 0.0], [0.5], [-0.5], [0.0], [0.0], [0.0], [0.0], [1.0, -2.0], [0.0], [1.0], [2.0]]


def test_ref_tokens_and_order(spark):
    assert column(spark, ["3;4", "3; 4", "Rampe 4", None, ""], tg.ref_tokens) == [["3", "4"], ["3", "4"], ["Rampe 4"], [], []]
    refs = ["10", "2", "A", "3a", "3", "1"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    assert [r[0] for r in df.orderBy(tg.natural_key(F.col("r"))).collect()] == ["1", "2", "3", "3a", "10", "A"]


def test_labels(spark):
    assert column(spark, ["Gl 1", "gleis 7", " 3a ", "", None, "Gleis"], track_ref) == ["1", "7", "3a", None, None, "Gleis"]
    assert column(spark, ["München Hbf", "Ångström"], fold_name) == ["munchen hbf", "angstrom"]
    assert column(spark, ["Alt-Lindow Süd 2"], fold_key) == ["altlindowsud2"]
    assert column(spark, ["3a", "41/42", "A", "ABC", "NO TRACK", "", "1234567"], plausible_track) == [True, True, True, False, False, False, False]


def test_hub_words(spark):
    names = ["Grünau Hbf (tief)", "Altstadthbf am Weißen See", "Hauptbahnhof", "Nordfeld/Westfeld Nordfeld (Ost", None, ""]
    want = [["grunau"], ["altstadt", "weissen", "see"], [], ["nordfeld", "westfeld", "ost"], None, []]
    assert column(spark, names, hub_tokens) == want


@pytest.mark.parametrize("walk,verdict", [(120.0, M.FEASIBLE), (280.0, M.TIGHT), (500.0, M.INFEASIBLE), (240.0, M.FEASIBLE), (300.0, M.TIGHT), (None, M.UNKNOWN)])
def test_verdict_boundaries(spark, walk, verdict):
    row = spark.createDataFrame([(walk, 300.0)], "w double, l double").select(journeys.classify(F.col("w"), F.col("l"))).first()
    assert row[0] == verdict


def test_label_reconciliation(spark):
    rows = [("7", "6/7", "89"), (None, "6/7", "89"), ("5", "6/7", "89"), ("7", None, "7"), ("7", None, "89")]
    df = spark.createDataFrame(rows, "m string, o string, f string")
    got = [r[0] for r in df.select(journeys.reconcile_label(F.col("m"), F.col("o"), F.col("f"))).collect()]
    assert got == ["7", "6/7", "6/7", None, "7"]


def test_rescued_only_when_the_real_walk_fits(spark):
    df = spark.createDataFrame([(100.0, 300.0, 290.0, 60.0, 0.0), (100.0, 300.0, 290.0, 250.0, 0.0), (100.0, 300.0, None, 0.0, 30.0)],
                               "walk_s double, layover_s double, assumed_s double, inbound_s double, outbound_s double").withColumns(journeys.live_score())
    got = [(r["verdict"], r["effective_s"], r["rescued"]) for r in df.collect()]
    assert got == [(M.FEASIBLE, 240.0, True), (M.INFEASIBLE, 50.0, False), (M.FEASIBLE, 330.0, False)]


def test_worst_verdict_wins_and_direct_is_feasible(spark):
    j = spark.createDataFrame([(1,), (2,), (3,)], "journey_id int")
    t = spark.createDataFrame([(1, M.TIGHT), (1, M.UNKNOWN), (2, M.FEASIBLE)], "journey_id int, verdict string")
    assert {r["journey_id"]: r["verdict"] for r in journeys.journey_verdicts(j, t).collect()} == {1: M.UNKNOWN, 2: M.FEASIBLE, 3: M.FEASIBLE}


def test_even_stride_above_the_cap(spark):
    refs = spark.createDataFrame([(1, str(i), i) for i in range(50)], "relation_id int, ref string, ord int")
    pairs = surveys.survey_pairs(refs, 24)
    kept = {r["from_ref"] for r in pairs.collect()} | {r["to_ref"] for r in pairs.collect()}
    assert kept == {str(int(i * (50 / 24))) for i in range(24)} and pairs.count() == 24 * 23 // 2


def test_radius_join_matches_brute_force(spark):
    from math import asin, cos, radians, sin, sqrt

    rng = random.Random(3)
    def pts(n, base):
        return [(i, base[0] + rng.uniform(-0.01, 0.01), base[1] + rng.uniform(-0.01, 0.01)) for i in range(n)]

    def hav(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * asin(sqrt(h))

    for base in ((47.0, 8.0), (78.0, -20.0), (-33.0, 151.0), (0.0, 0.0)):
        left, right = pts(60, base), pts(60, base)
        got = spatial.radius_join(spark.createDataFrame(left, "a int, lat double, lon double"), spark.createDataFrame(right, "b int, lat double, lon double"), 250.0)
        assert {(r["a"], r["b"]) for r in got.collect()} == {(x[0], y[0]) for x in left for y in right if hav(x, y) <= 250.0}


def test_radius_join_across_the_antimeridian(spark):
    left = spark.createDataFrame([(1, 10.0, 179.9999)], "a int, lat double, lon double")
    right = spark.createDataFrame([(2, 10.0, -179.9999)], "b int, lat double, lon double")
    assert spatial.radius_join(left, right, 100.0).count() == 1


def test_concave_ring(spark):
    ring = spark.createDataFrame([(1, i, la, lo) for i, (la, lo) in enumerate([(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (2.0, 2.0), (4.0, 0.0)])],
                                 "ring_id int, pos int, lat double, lon double")
    pts = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (3, 3.0, 0.5), (4, 5.0, 5.0)], "id int, lat double, lon double")
    assert {r["id"] for r in spatial.points_in_rings(pts, ring, step_deg=0.5).collect()} == {1, 3}


def test_ladder_prefers_the_precise_rung(spark):
    ways = spark.createDataFrame([
        (1, [1, 2], {"railway": "platform_edge", "ref": "3"}), (2, [3, 4], {"railway": "platform", "ref": "3"}),
        (3, [5, 6], {"railway": "platform_edge", "railway:track_ref": "412/422"}), (4, [7], {"public_transport": "platform", "local_ref": "7; 8"}),
        (5, [8], {"railway": "platform", "ref": "Rampe 4"})], M.WAYS)
    foot = spark.createDataFrame([(9, i) for i in range(1, 6)], "relation_id int, way_id bigint")
    asked = spark.createDataFrame([(9, r) for r in ("3", "12", "8", "1")], "relation_id int, ref string")
    got = {(r["ref"], r["way_id"], r["rung"]) for r in platforms.resolve_platforms(asked, foot, ways).collect()}
    assert got == {("3", 1, 1), ("12", 3, 2), ("8", 4, 6)}


def test_access_needs_both_ends_rated(spark):
    rows = [(False, None, None, None), (True, True, False, None), (True, False, None, True)]
    df = spark.createDataFrame(rows, "arr_step_free boolean, dep_step_free boolean, arr_has_lift boolean, dep_has_lift boolean")
    assert [(r["step_free"], r["has_lift"]) for r in platforms.combine_access(df).collect()] == [(None, None), (True, False), (False, True)]


def test_actual_formation_drops_power_cars(spark):
    car = '{"wagenordnungsnummer":"%s","kategorie":"%s","fahrzeugsektor":"A","positionamhalt":{"startprozent":"%s","endeprozent":"%s"}}'
    text = '{"data":{"istformation":{"fahrtnummer":"124","allFahrzeuggruppe":[{"fahrzeuggruppebezeichnung":"g","allFahrzeug":[%s,%s]}],"allSektor":[{"sektorbezeichnung":"A","positionamgleis":{"startmeter":"0","endemeter":"400"}}]}}}' % (
        car % ("1", "TRIEBKOPF", "0", "10"), car % ("2", "REISEZUGWAGENZWEITEKLASSE", "10", "20"))
    rows = feeds.coaches_from_actual(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r["coach"], r["class"], r["start_m"], r["end_m"]) for r in rows] == [("2", "2", 40.0, 80.0)]


def test_fill_prefers_same_terminus(spark):
    boards = spark.createDataFrame([(1, 0, "S S8", "Airport", "3"), (1, 1, "S S8", "Town", "5"), (1, 2, "S S8", "Town", "5"), (1, 3, "RE 1", "Lake", "9")],
                                   "hub int, seq int, line string, dest string, platform string")
    asked = spark.createDataFrame([(1, 1, "S8", "airport"), (2, 1, "S8", "nowhere"), (3, 1, "RE1", ""), (4, 1, "X", "a")], "ask_id int, hub int, line string, headsign string")
    got = {r["ask_id"]: (r["platform"], r["how"]) for r in delays.fill_platforms(asked, boards).collect()}
    assert got == {1: ("3", "exact"), 2: ("5", "line_major"), 3: ("9", "line_unique"), 4: (None, "none")}


def test_all_pairs_without_a_cap(spark):
    refs = spark.createDataFrame([(1, str(i), i) for i in range(50)], "relation_id int, ref string, ord int")
    assert surveys.survey_pairs(refs).count() == 50 * 49 // 2


def test_far_ways_are_reached(spark):
    """A chain of 40 walkable ways: each hop is counted, and an edge at its end finds the station at its start."""
    footway = {"highway": "footway"}
    ways = spark.createDataFrame([(i, [i, i + 1], footway) for i in range(40)] + [(90, [900, 901], footway)], "id long, nodes array<long>, tags map<string,string>")
    start = spark.createDataFrame([(1, 0)], "search int, way_id long")
    goals = spark.createDataFrame([(1, i) for i in [*range(40), 90]], "search int, way_id long")
    assert {r.way_id: r.hops for r in walks.way_hops(ways, start, goals).collect()} == {i: i for i in range(40)}
    assert {r.way_id for r in walks.way_hops(ways, start, goals, 6).collect()} == set(range(7))
    station = spark.createDataFrame([(7, 0)], "relation_id long, way_id long")
    edge = ways.where("id in (20, 90)")
    got = linkage.edge_stations(edge, station, ways).collect()
    assert [(r.way_id, r.relation_id) for r in got] == [(20, 7)] and got[0].rounds > 10


def test_radius_is_the_caller_s(spark):
    pois = spark.createDataFrame([(1, 50.0, 8.0065), (2, 50.0, 8.02)], "id long, lat double, lon double")
    path = spark.createDataFrame([(5, 50.0, 8.0)], "path_id long, lat double, lon double")
    assert [r.poi_id for r in heights.pois_near_path(pois, path, 600.0).collect()] == [1]
