"""Walk semantics on literal maps and random graphs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.operators import graph, walks
from footbridge.session import cut

EDGE = "src bigint, src_lv double, dst bigint, dst_lv double, seconds double, metres double, way_id bigint, from_pos int, to_pos int, lift boolean"


def edges_of(spark, rows):
    P = graph.PLAIN
    return spark.createDataFrame([(a, P, b, P, float(w), float(w) * 1.4, 1, 0, 1, False) for a, b, w in rows], EDGE)


def ask(spark, edges, starts, goals, cutoff=900.0, rounds=2):
    req = spark.createDataFrame([("r", "s", "g", cutoff)], "request_id string, start_key string, goal_key string, cutoff_s double")
    s = spark.createDataFrame([("s", n) for n in starts], "start_key string, node_id bigint")
    g = spark.createDataFrame([("g", n) for n in goals], "goal_key string, node_id bigint")
    return walks.shortest_walks(req, s, g, edges, rounds_per_job=rounds).first()


def test_detour_beats_direct_edge(spark):
    row = ask(spark, edges_of(spark, [(1, 3, 10), (1, 2, 3), (2, 3, 3)]), [1], [3])
    assert row["found"] and row["seconds"] == pytest.approx(6.0)


def test_zero_hop(spark):
    row = ask(spark, edges_of(spark, [(1, 2, 5)]), [1], [1, 2])
    assert row["found"] and row["seconds"] == 0.0


def test_disconnected_and_exceeded(spark):
    edges = edges_of(spark, [(1, 2, 5), (3, 4, 5), (2, 5, 1000), (5, 6, 1)])
    assert ask(spark, edges_of(spark, [(1, 2, 5), (3, 4, 5)]), [1], [4])["reason"] == M.DISCONNECTED
    assert ask(spark, edges, [1], [6])["reason"] == M.EXCEEDED
    # a dearer offer for a vertex already reached does not count as cut
    assert ask(spark, edges_of(spark, [(1, 2, 5), (1, 2, 2000)]), [1], [9])["reason"] == M.DISCONNECTED


def test_random_graphs_match_a_heap_search(spark):
    rng = random.Random(7)
    for size in (8, 30):
        rows = [(rng.randrange(size), rng.randrange(size), rng.randint(1, 20)) for _ in range(size * 2)]
        adj = {}
        for a, b, w in rows:
            adj.setdefault(a, []).append((b, w))
        best, heap = {}, [(0, 0), (0, 1)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in best:
                continue
            best[u] = d
            for v, w in adj.get(u, []):
                heapq.heappush(heap, (d + w, v))
        starts = spark.createDataFrame([("s", 0, 0.0, 900.0), ("s", 1, 0.0, 900.0)], "search string, node bigint, start_s double, limit_s double")
        got = walks.spread(cut(walks.adjacency(edges_of(spark, rows))), starts, rounds_per_job=3)
        assert {r["node"]: r["seconds"] for r in got.collect()} == pytest.approx(best)


def small_map(spark, lift_node=False):
    """Two floors joined by stairs of four nodes; a footway on each floor."""
    n = [(i, 47.0 + (i // 10) * 0.0005, 8.0 + (i % 10) * 0.0003, {"highway": "elevator"} if lift_node and i == 4 else {}) for i in range(20)]
    ways = [
        (1, [0, 1, 2, 3, 4], {"highway": "footway"}), (2, [14, 13, 12, 11, 10], {"highway": "footway", "level": "1"}),
        (3, [4, 5, 15, 14], {"highway": "steps", "level": "0;1"}),
    ]
    if lift_node:
        ways.append((4, [4, 9], {"highway": "footway", "level": "2"}))
    return spark.createDataFrame(n, M.NODES), spark.createDataFrame(ways, M.WAYS)


def test_contraction_keeps_costs_and_paths(spark):
    nodes, ways = small_map(spark)
    req = spark.createDataFrame([(1, "a", "b", 900.0)], "request_id int, start_key string, goal_key string, cutoff_s double")
    s = spark.createDataFrame([("a", 0)], "start_key string, node_id bigint")
    g = spark.createDataFrame([("b", 10)], "goal_key string, node_id bigint")
    out = {}
    for contract in (False, True):
        keep = spark.createDataFrame([(0,), (10,)], "node_id bigint")
        edges = cut(graph.walk_edges(ways, nodes, keep, contract))
        walk = walks.shortest_walks(req, s, g, edges, with_path=True)
        path = [r["node_id"] for r in walks.path_nodes(walks.path_hops(walk), ways).orderBy("seq").collect()]
        out[contract] = (walk.first()["seconds"], path, edges.count())
    assert out[True][0] == pytest.approx(out[False][0]) and out[True][1] == out[False][1] == [0, 1, 2, 3, 4, 5, 15, 14, 13, 12, 11, 10]
    assert out[True][2] < out[False][2]


def test_node_lift_costs_a_wait_and_step_free_avoids_it(spark):
    nodes, ways = small_map(spark, lift_node=True)
    edges = cut(graph.walk_edges(ways, nodes))
    up = edges.where("src = 4 and dst = 4 and src_lv = 0 and dst_lv = 2").first()
    assert up["seconds"] == pytest.approx(30 + 8 / 1.4)
    free = graph.apply_profile(edges, step_free=True)
    assert free.where("src = 4 and dst = 4").count() == 0


def test_missing_coordinates_break_a_segment(spark):
    nodes, ways = small_map(spark)
    gone = nodes.where("id <> 2")
    for contract in (False, True):
        pairs = {(r["src"], r["dst"]) for r in graph.walk_edges(ways.where("id = 1"), gone, contract=contract).collect()}
        assert pairs == {(0, 1), (1, 0), (3, 4), (4, 3)}


def test_one_way_and_escalator_direction(spark):
    nodes, _ = small_map(spark)
    ways = spark.createDataFrame([(1, [0, 1], {"conveying": "backward"}), (2, [2, 3], {"oneway": "yes"})], M.WAYS)
    assert {(r["src"], r["dst"]) for r in graph.walk_edges(ways, nodes).collect()} == {(1, 0), (2, 3)}


def test_relation_closure_survives_cycles(spark):
    rows = [(1, 0, "R", 2, ""), (2, 0, "R", 3, ""), (3, 0, "R", 1, ""), (3, 1, "W", 30, ""), (2, 1, "N", 20, "")]
    got = graph.relation_closure(spark.createDataFrame(rows, M.MEMBERS))
    want = {(r, "W", 30) for r in (1, 2, 3)} | {(r, "N", 20) for r in (1, 2, 3)}
    assert {tuple(r) for r in got.collect()} == want


def test_unknown_distance_is_null(spark):
    from footbridge.functions.geo import haversine

    row = spark.createDataFrame([(None, 8.0)], "lat double, lon double").select(
        haversine(F.col("lat"), F.col("lon"), F.lit(47.0), F.lit(8.0)).alias("d")).first()
    assert row["d"] is None


def test_few_starts_use_several_tasks(spark):
    edges = edges_of(spark, [(1, 2, 1.0), (2, 3, 2.0)])
    starts = spark.range(64).selectExpr("id as search", "1L as node", "0D as start_s", "900D as limit_s")
    state = walks.spread(walks.adjacency(edges), starts)
    assert len(state.inputFiles()) > 1
    got = {(r.search, r.node): r.seconds for r in state.collect()}
    assert got == {(s, n): t for s in range(64) for n, t in ((1, 0.0), (2, 1.0), (3, 3.0))}


def test_rows_by_node_or_by_search_give_the_same_table(spark):
    P = graph.PLAIN
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.choice([P, 0.0, 1.0]), rng.randrange(20), rng.choice([P, 0.0, 1.0]), float(rng.randint(1, 9)), 1.0, 1, 0, 1, False) for _ in range(300)]
    next_of = cut(walks.adjacency(spark.createDataFrame(rows, EDGE)))
    starts = spark.createDataFrame([("s", 0, 0.0, 30.0), ("s", 4, 1.0, 30.0), ("t", 7, 0.0, 12.0)], "search string, node bigint, start_s double, limit_s double")

    def got(few):
        state = walks.spread(next_of, starts, rounds_per_job=3, with_origin=True, few=few)
        return sorted(tuple(r) for r in state.select("search", "node", "lv", "seconds", "origin").collect())

    assert len(got(10 ** 6)) > 20 and got(0) == got(10 ** 6)


def test_a_round_over_a_large_graph_shuffles_its_rows_once(spark):
    limits = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        next_of = cut(walks.adjacency(edges_of(spark, [(i, i + 1, 1) for i in range(50)])))
        shell = spark.range(3).selectExpr("'s' as search", "id as node", f"cast({graph.PLAIN} as double) as lv", "0D as seconds", "0D as metres", "9D as limit_s", "true as fresh")

        def chain(n):
            rows = shell.repartition(4, "node")
            around = walks.by_node(next_of, 4)
            for _ in range(n):
                rows = walks._round(rows, around, False, parts=4)
            return rows._jdf.queryExecution().executedPlan().toString()

        # what a round adds besides the graph, which all rounds share
        added = [chain(n).count("Exchange hashpartitioning(node") - chain(n).count("ReusedExchange") for n in (1, 3)]
        assert chain(3).count("hashpartitioning(search") == 0 and added[1] - added[0] <= 2
    finally:
        for k, v in limits.items():
            spark.conf.set(k, v)
