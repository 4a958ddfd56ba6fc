"""The search in blocks of the map against the search in rounds."""

import random

from pyspark.sql import functions as F

from footbridge.operators import blocks, graph, walks
from footbridge.session import cut

EDGE = "src bigint, src_lv double, dst bigint, dst_lv double, seconds double, metres double, way_id bigint, from_pos int, to_pos int, lift boolean"
START = "search string, node bigint, start_s double, limit_s double"


def town(spark, side=10):
    """A grid of streets, some one-way, some on another floor, with a long road across and a vertex nobody knows the place of."""
    rng, P = random.Random(5), graph.PLAIN
    rows = []
    for i in range(side * side):
        for j in ([i + 1] if (i + 1) % side else []) + ([i + side] if i + side < side * side else []):
            for a, b in ((i, j), (j, i)):
                if rng.random() < 0.8:
                    rows.append((a, rng.choice([P] * 9 + [1.0]), b, rng.choice([P] * 9 + [1.0]), rng.uniform(0, 30), rng.uniform(1, 40), 1, 0, 1, False))
    rows += [(0, P, side * side - 1, P, 90.0, 100.0, 1, 0, 1, False), (3, P, 900, P, 4.0, 4.0, 1, 0, 1, False), (900, P, 50, P, 4.0, 4.0, 1, 0, 1, False)]
    rows += [(7, None, 8, P, 0.1, 0.1, 1, 0, 1, False), (9, P, 10, P, None, 0.1, 1, 0, 1, False)]
    nodes = [(i, 47.0 + (i // side) * 0.0006, 8.0 + (i % side) * 0.0006) for i in range(side * side)] + [(900, None, None)]
    return cut(spark.createDataFrame(rows, EDGE)), spark.createDataFrame(nodes, "id bigint, lat double, lon double")


def table(state):
    return {(r.search, r.node, r.lv): (round(r.seconds, 6), r.limit_s) for r in state.collect() if r.seconds is not None}


def test_blocks_and_rounds_give_the_same_table(spark):
    edges, nodes = town(spark)
    starts = spark.createDataFrame(
        [("a", 0, 0.0, 200.0), ("a", 5, 3.0, 200.0), ("b", 60, 0.0, 1e9), ("c", 95, 1.0, 20.0), ("d", 5000, 0.0, 90.0), ("e", 3, 0.0, 60.0), ("f", 3, None, 60.0)], START)
    want = table(walks.spread(cut(walks.adjacency(edges)), starts))
    for most in (40, 8192):
        got = table(blocks.spread(edges, nodes, starts, most=most))
        assert got == want and len(got) > 150
    assert cut(blocks.blocks(edges, nodes, 40)).select("block").distinct().count() > 5


def test_a_settled_search_goes_no_further_than_its_goals(spark):
    edges, nodes = town(spark)
    starts = spark.createDataFrame([("a", 0, 0.0, 1e9), ("b", 60, 0.0, 1e9)], START)
    goals = spark.createDataFrame([("a", 11), ("a", 22), ("b", 7777)], "search string, node bigint")
    free = table(blocks.spread(edges, nodes, starts, most=60))
    held = table(blocks.spread(edges, nodes, starts, goals, most=60))
    assert all(held["a", n, graph.PLAIN] == free["a", n, graph.PLAIN] for n in (11, 22))
    assert {k: v for k, v in held.items() if k[0] == "b"} == {k: v for k, v in free.items() if k[0] == "b"} and len(held) < len(free)


def test_rounds_follow_blocks_not_junctions(spark, monkeypatch):
    P = graph.PLAIN
    edges = cut(spark.createDataFrame([(i, P, i + 1, P, 1.0, 1.0, 1, 0, 1, False) for i in range(60)], EDGE))
    nodes = spark.range(61).select("id", (F.lit(47.001) + F.col("id") * 0.00001).alias("lat"), F.lit(8.001).alias("lon"))
    written = []
    for module in (blocks, walks):
        real = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, real=real, **m: (written.append(tuple(m)), real(df, **m))[1])
    asked = spark.createDataFrame([(1, "s", "g", 900.0)], "request_id int, start_key string, goal_key string, cutoff_s double")
    start = spark.createDataFrame([("s", 0)], "start_key string, node_id bigint")
    goal = spark.createDataFrame([("g", 60)], "goal_key string, node_id bigint")
    by_rounds = walks.shortest_walks(asked, start, goal, edges).drop("reach_s").first()
    assert written.count(("fresh",)) >= 8 and ("out",) not in written
    written.clear()
    assert walks.shortest_walks(asked, start, goal, edges, nodes=nodes).drop("reach_s").first() == by_rounds
    assert written.count(("out",)) <= 4 and ("fresh",) not in written
