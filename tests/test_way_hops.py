from types import SimpleNamespace

from footbridge.plans import height_queries


def test_query_reaches_far_ways(spark):
    """The registered query has no bound: ways nine changes away get their row."""
    ways = spark.createDataFrame([(1000 + i, [i, i + 1], {"highway": "footway"}) for i in range(10)], "id long, nodes array<long>, tags map<string,string>")
    plat = spark.createDataFrame([(1, 0)], "st long, p int")
    got = height_queries.way_hops(SimpleNamespace(ways=ways, view=lambda name: plat)).collect()
    assert {r.way_id: r.hops for r in got} == {1000 + i: i for i in range(10)}
