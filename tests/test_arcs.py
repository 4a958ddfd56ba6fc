"""Shared arcs of rings against a plain walk around each ring."""

from footbridge.operators.topology import arc_points, edge_owners, prepare_rings, shared_arcs

BOX = (-1000.0, -1000.0, 1000.0, 1000.0)


def ring(i, points):
    return [(i, p, float(x), float(y)) for p, (x, y) in enumerate([*points, points[0]])]


def plain_arcs(rows):
    rings, owners = {}, {}
    for i, _, x, y in rows:
        rings.setdefault(i, []).append((x, y))
    for i, pts in rings.items():
        for e in zip(pts, pts[1:]):
            owners.setdefault(frozenset(e), set()).add(i)
    arcs = set()
    for pts in rings.values():
        edges = list(zip(pts, pts[1:]))
        sig = [frozenset(owners[frozenset(e)]) for e in edges]
        starts = [k for k in range(len(edges)) if sig[k] != sig[k - 1]] or [0]
        for s in starts:
            arc, k = [edges[s][0]], s
            while True:
                arc.append(edges[k][1])
                k = (k + 1) % len(edges)
                if k in starts:
                    break
            arcs.add((tuple(sorted(sig[s])), min(tuple(arc), tuple(reversed(arc)))))
    return arcs


def traced(spark, rows):
    rings = spark.createDataFrame(rows, "ring_id long, pos long, x double, y double")
    return arc_points(rings, edge_owners(rings, BOX))


def test_arcs_equal_a_plain_walk(spark):
    rows = (
        ring(1, [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (0, 2)])
        + ring(2, [(2, 0), (4, 0), (4, 2), (2, 2), (2, 1)])       # shares two edges with 1, across its own start
        + ring(3, [(10, 10), (12, 10), (12, 12)])                  # alone: one closed arc
        + ring(4, [(12, 12), (12, 10), (20, 10), (20, 12)])        # shares an edge with 3, walked the other way
        + ring(5, [(30, 0), (31, 0), (31, 1)]) + ring(6, [(30, 0), (31, 1), (31, 0)]))  # the same ring both ways
    points = traced(spark, rows).cache()
    got = {}
    for r in points.collect():
        got.setdefault((r.arc_key, r.owners, r.n_points), {})[r.seq] = (r.x, r.y)
    assert all(sorted(p) == list(range(k[2])) for k, p in got.items())
    arcs = {(tuple(map(int, k[1].split(","))), tuple(p[i] for i in sorted(p))) for k, p in got.items()}
    assert arcs == plain_arcs(rows) and len(got) == len(arcs)
    assert shared_arcs(points).where("kind = 'border'").count() == 3


def test_long_ring_takes_few_rounds(spark):
    n = 40_000
    half = n // 2
    rows = spark.range(n + 1).selectExpr("1L as ring_id", "id as pos", f"cast(pmod(id, {n}) as double) as x", "0.5D as y")
    other = spark.range(half + 2).selectExpr(
        "2L as ring_id", "id as pos", f"cast(case when id <= {half} then id else 0 end as double) as x", "0.5D as y")
    rings = rows.unionByName(other)
    got = {(r.owners, r.n_points) for r in shared_arcs(arc_points(rings, edge_owners(rings, BOX))).collect()}
    assert got == {("1,2", half + 1), ("1", n - half + 1), ("2", 2)}


def test_no_rings(spark):
    assert traced(spark, []).count() == 0


def test_preparing_rings_does_not_repeat_its_steps(spark):
    rows = (
        ring(1, [(0, 0), (1, 0), (1, 0.0001), (1, 1), (0, 1)])         # a vertex that meets the one before once snapped
        + ring(2, [(5000, 0), (5001, 0), (5001, 1)])                   # beyond the box
        + ring(3, [(0, 0), (0.01, 0), (0.01, 0.01)])                   # too small
        + [(4, 0, 0.0, 0.0), (4, 1, 2.0, 0.0), (4, 2, 2.0, 2.0), (4, 3, 0.0, 2.0)]   # not closed
        + [(None, 0, 0.0, 0.0), (None, 1, 2.0, 0.0), (None, 2, 2.0, 2.0), (None, 3, 0.0, 0.0)])
    got = prepare_rings(spark.createDataFrame(rows, "ring_id long, pos long, x double, y double"), BOX, 0.01)
    assert [tuple(r) for r in got.orderBy("ring_id", "pos").collect()] == (
        ring(1, [(0, 0), (1, 0), (1, 1), (0, 1)]) + ring(4, [(0, 0), (2, 0), (2, 2), (0, 2)]))
    # what reads the rings sorts nothing of their preparation again
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
