import random

from pyspark.sql import functions as F

from footbridge.operators import components as C


def slow(edges):
    least = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components_like_plain_code(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000, 1000), (2000, 2001), (2001, 2000)]
    edges += [(5000, 5001 + i) for i in range(300)] + [(9000 - i, 9001 - i) for i in range(150)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == slow(edges)
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, **m: (rounds.append(1), real(df, **m))[1])
    got = C.components(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    assert len(got) == 3001 and {r.component for r in got} == {0} and len(rounds) <= 16


def test_bridges_join_components(spark):
    own = spark.createDataFrame([(1, 1), (2, 1), (10, 10), (11, 10), (20, 20), (30, 30)], "node_id long, component long")
    bridges = spark.createDataFrame([(2, 11, 5.0), (11, 20, 7.0)], "node_a long, node_b long, dist_m double")
    stitched = C.stitched_components(own, bridges)
    assert {r.component: r.stitched for r in stitched.collect()} == {1: 1, 10: 1, 20: 1, 30: 30}
    ends = spark.createDataFrame([(7, "1", 1, 1), (7, "1", 30, 30), (7, "2", 10, 1), (7, "3", 30, 30), (7, "4", 1, 1), (7, "5", 44, 44)], "relation_id long, ref string, component long, stitched long")
    pairs = [(7, a, b) for a in "12345" for b in "12345" if a < b]
    got = C.reachable_pairs(spark.createDataFrame(pairs, "relation_id long, from_ref string, to_ref string"), ends).collect()
    assert {(r.from_ref, r.to_ref): r.near for r in got} == {("1", "2"): False, ("1", "3"): True, ("1", "4"): True, ("2", "4"): False}
