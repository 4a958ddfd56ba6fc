import numpy as np
import pytest
from pyspark.sql import functions as F

from footbridge.llm import cover_tree as C
from footbridge.session import materialise


def brute(rows, asks, k):
    """rows: (id, vector or None) -> {(query, rank): (id, score)}."""
    good = {(i, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q, a in good:
        if asks(q):
            found = sorted((-min(sum(x * y for x, y in zip(a, b, strict=False)), C.MOST), i) for i, b in good if i != q)
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def run(spark, rows, k=5, every=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, vec string")
    got = C.top_k(df.select("vec_id", C.whole_vector(F.col("embedding")).alias("vec")), F.col("vec_id") % every == 0, k)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()}


def rows_of(n, d, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    return [(i, (middle[i % 6] + rng.normal(size=d) * 0.3 * (i % 4)).round(2).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard", [4096, 30])
def test_same_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "BLOCK", 25)
    rows = rows_of(400, 8, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a hot vector, a third of the queries
    rows += [(2000, None), (2001, []), (2004, [1.0, None] * 4), (2007, [float("nan")] * 8), (2010, [float("inf")] * 8), (None, [1.0] * 8), (2013, [3.0, 1.0]), (2016, [0.0] * 8)]
    rows += rows[:5]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, lambda i: i % 3 == 0, 5)
    assert run(spark, []) == {} and run(spark, [(1, [1.0])]) == {}


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(3e6 + 17 * i)), float(np.float32(-1e5 * i))]) for i in range(30)]
    assert run(spark, rows) == brute([(i, [float(x) for x in np.array(v, dtype=np.float32)]) for i, v in rows], lambda i: i % 3 == 0, 5)


def test_bounds_hold_under_every_node():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (500, 5))
    tree = C.CoverTree(v, np.arange(500))
    for node in range(len(tree.radius)):
        under = tree.vectors[tree.begin[node] : tree.end[node]].astype(float)
        assert np.sqrt(((under - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
    kids = np.flatnonzero(tree.last)
    assert sorted(tree.ids) == list(range(500)) and len(kids) > 3
    for node in kids:
        c = tree.centre[tree.first[node] : tree.last[node]].astype(float)
        apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[~np.eye(len(c), dtype=bool)]
        assert (apart > tree.radius[node] / C.BASE - 1e-9).all()


def test_partitions_do_not_send_a_sample_each(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 400)
    n = 16000
    vec = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)))
    points = materialise(spark.range(n).repartition(16).select(F.col("id").alias("vec_id"), vec.alias("vec")))[0]
    want = [r.vec for r in points.orderBy(F.xxhash64("vec"), "vec_id").limit(400).collect()]
    assert points.rdd.getNumPartitions() >= 8
    plans = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64m"}  # a partition a file
    before = {key: spark.conf.get(key) for key in plans}
    for key, value in plans.items():
        spark.conf.set(key, value)
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "1m")  # the sample itself takes some 0.2 MB, one of each partition some 1.7
    try:
        got = C.sampled(points, n)
        top = C.top_k(points, F.col("vec_id") < 3, 2)
        assert sorted((r.query_id, r["rank"]) for r in top.collect()) == [(q, k) for q in range(3) for k in (1, 2)]
    finally:
        conf.remove("spark.driver.maxResultSize")
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want
    assert C.sampled(points.limit(7), 7) == [r.vec for r in points.limit(7).orderBy(F.xxhash64("vec"), "vec_id").collect()]
