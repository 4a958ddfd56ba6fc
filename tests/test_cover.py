import numpy as np
import pandas as pd

from footbridge.operators import spatial


def crossings(lat, lon, ring):
    """True for the points with an odd number of edges north of them."""
    y, x = ring[:, 0], ring[:, 1]
    inside = np.zeros(len(lat), bool)
    for yi, xi, yj, xj in zip(y, x, np.roll(y, 1), np.roll(x, 1), strict=True):
        if xi != xj:
            inside ^= ((xi > lon) != (xj > lon)) & (lat < (yj - yi) * (lon - xi) / (xj - xi) + yi)
    return inside


def star(n, lat, lon, radius, seed):
    """A jagged ring of n vertices around a place."""
    rng = np.random.default_rng(seed)
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = radius * (0.6 + 0.4 * rng.random(n))
    return np.column_stack([lat + r * np.sin(turn), lon + r * np.cos(turn)])


def compare(spark, rings, lat, lon, **options):
    points = spark.createDataFrame(pd.DataFrame({"id": range(len(lat)), "lat": lat, "lon": lon}))
    rows = [(k, pos, float(a), float(b)) for k, ring in rings.items() for pos, (a, b) in enumerate(ring)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["ring_id", "pos", "lat", "lon"]))
    got = spatial.points_in_rings(points, table, **options).toPandas()
    want = {(k, i) for k, ring in rings.items() for i in np.flatnonzero(crossings(lat, lon, ring))}
    assert len(got) == len(want) and set(zip(got.ring_id, got.id, strict=True)) == want
    return table


def test_jagged_rings_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    rings = {1: star(3000, 10.0, 20.0, 15.0, 2), 2: star(500, 10.3, 20.2, 0.4, 3), 3: star(7, 10.3, 20.2, 0.0004, 4), 4: star(40, -0.001, 0.001, 0.01, 5)}
    lat = np.concatenate([rng.uniform(-8, 28, 3000), 10.3 + rng.uniform(-0.5, 0.5, 1500), 10.3 + rng.uniform(-5e-4, 5e-4, 800), rng.uniform(-0.02, 0.02, 800)])
    lon = np.concatenate([rng.uniform(2, 38, 3000), 20.2 + rng.uniform(-0.5, 0.5, 1500), 20.2 + rng.uniform(-5e-4, 5e-4, 800), rng.uniform(-0.02, 0.02, 800)])
    table = compare(spark, rings, lat, lon)
    cover = spatial.ring_cover(table).toPandas()
    assert cover[cover.ring_id == 1].held.max() <= spatial.CROWD
    assert ((cover.held == 0) & (cover.ring_id == 1)).sum() > 10
    assert cover[cover.held == 0][spatial.ENDS].isna().all(axis=None)


def test_points_and_vertices_on_cell_borders(spark):
    """Corners, borders and vertical edges at powers of two, where cells meet; a cell may hold one edge only."""
    steps = np.array([(0, 0), (0, 4), (2, 4), (2, 2), (3, 2), (3, 1), (4, 1), (4, -1), (1, -1), (1, 0)], float)
    grid = np.arange(-1.5, 5, 0.25)
    lat, lon = (a.ravel() for a in np.meshgrid(grid, grid))
    compare(spark, {7: steps, 8: steps / 64 + 0.5, 9: np.array([(0, 0), (1, 1)], float)[:0]}, lat, lon, crowd=1)


def test_empty_and_tiny_rings(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 1.0)], "id long, lat double, lon double")
    none = spark.createDataFrame([], "ring_id long, pos int, lat double, lon double")
    two = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0)], none.schema)
    assert spatial.points_in_rings(points, none).collect() == [] and spatial.points_in_rings(points, two).collect() == []
    boxes = spark.createDataFrame([(1, -60.0, 60.0, -170.0, 170.0), (2, 0.5, 0.5, 0.5, 0.5), (3, 0.6, 0.7, 0.0, 1.0)], "box int, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    assert sorted((r.id, r.box) for r in spatial.in_boxes(points, boxes).collect()) == [(1, 1), (1, 2)]
