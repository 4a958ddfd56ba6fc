"""Seats along a platform and the walks from their doors."""

import random

import pytest
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.operators import boarding, graph, walks
from footbridge.plans import boarding_queries

EDGE = "src bigint, src_lv double, dst bigint, dst_lv double, seconds double, metres double, way_id bigint, from_pos int, to_pos int, lift boolean"


def test_offsets_fall_on_one_segment(spark):
    # the second vertex is there twice, so one segment has no length
    lines = spark.createDataFrame(
        [(1, p, 10 + p, 47.0, 8.0 + c / 100, c, 40.0) for p, c in enumerate([0.0, 10.0, 10.0, 40.0])],
        "line long, pos long, node_id long, lat double, lon double, cum double, length_m double")
    points = spark.createDataFrame([(i, 1, o) for i, o in enumerate([-5.0, 0.0, 9.0, 10.0, 25.0, 40.0, 45.0])] + [(4, 1, 25.0)],
                                   "seat_id long, line long, offset_m double")
    out = boarding._bracket(points, lines)
    got = {r.seat_id: (r.at_m, r.c0) for r in out.collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (9, 0), 3: (10, 10), 4: (25, 10), 5: (40, 10), 6: (40, 10)} and out.count() == 7
    # no group of the points' segments is built
    assert "_by(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_seats_that_share_a_goal_share_a_search(spark, monkeypatch):
    rng, P = random.Random(3), graph.PLAIN
    rows = [(rng.randrange(20), rng.randrange(20), rng.uniform(1, 20)) for _ in range(45)] + [(50, 51, 1.0)]
    edges = spark.createDataFrame([(a, P, b, P, w, w * 1.4, 1, 0, 1, False) for a, b, w in rows], EDGE)
    points = spark.createDataFrame(
        [(s, s % 19, s % 19 + 1, s * 0.3, 6 - s * 0.3, "far" if s == 7 else "goal") for s in range(19)] + [(30, 50, 51, 1.0, 1.0, "goal")],
        "seat_id long, node_a long, node_b long, to_a_s double, to_b_s double, goal_key string")
    goals = spark.createDataFrame([("goal", 3), ("goal", 11), ("far", 5), ("unasked", 6)], "goal_key string, node_id long")
    searches = []
    plain = walks.spread
    monkeypatch.setattr(walks, "spread", lambda n, starts, *a, **k: searches.append(starts.select("search").distinct().count()) or plain(n, starts, *a, **k))
    got = {r.seat_id: r for r in boarding.seat_walks(points, goals, edges).collect()}
    assert searches == [2]
    want = {r.seat_id: r for r in boarding.seat_walks(points, goals, edges, cutoff_s=1e6).collect()}
    assert len(got) == len(want) == 20 and {r.found for r in got.values()} == {True, False}
    for s, w in want.items():
        g = got[s]
        assert (g.found, g.reached_node, g.reason) == (w.found, w.reached_node, w.reason)
        if w.found:
            assert (g.seconds, g.metres) == pytest.approx((w.seconds, w.metres))
    assert got[30].reason == M.DISCONNECTED


def test_equally_near_starts_give_the_least(spark):
    P = graph.PLAIN
    edges = spark.createDataFrame([(a, P, 9, P, 5.0, 7.0, 1, 0, 1, False) for a in (4, 2, 3)], EDGE)
    starts = spark.createDataFrame([("s", a, 0.0, 900.0) for a in (4, 2, 3)], "search string, node long, start_s double, limit_s double")
    state = walks.spread(walks.adjacency(edges), starts, with_origin=True)
    assert state.where(F.col("node") == 9).first().origin == 2


def test_every_seat_of_a_spot_has_its_walk(spark, monkeypatch):
    P = graph.PLAIN
    edges = spark.createDataFrame([(a, P, b, P, s, s * 1.4, 1, 0, 1, False) for a, b, s in ((1, 9, 30.0), (2, 9, 25.0))], EDGE)
    seats = [(10 + i, 0.0 + i, 10.0 - i) for i in range(10)]
    monkeypatch.setattr(boarding_queries, "alighting", lambda w: spark.createDataFrame(
        [(s, 1000, 1, 2, a, b) for s, a, b in seats] + [(30, 1000, 5, 6, 1.0, 2.0)],
        "seat_id long, platform long, node_a long, node_b long, to_a_s double, to_b_s double"))
    monkeypatch.setattr(boarding_queries, "stations", lambda w: None)
    monkeypatch.setattr(boarding_queries, "graph_edges", lambda *a: edges)

    class Goals:
        def view(self, name):
            return spark.createDataFrame([(1005, 9), (2005, 1)], "way_id long, node_id long")

    got = {r.seat_id: (r.n_seats, r.found, r.seconds, r.metres) for r in boarding_queries.seat_walks(Goals()).collect()}
    want = {s: (10, True, min(a + 30, b + 25), round(min(a + 30, b + 25) * 1.4, 1)) for s, a, b in seats}
    assert got == want | {30: (1, False, None, None)}
