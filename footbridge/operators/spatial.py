"""Spatial joins as equi-joins on grid cells.

A range predicate alone would make Spark plan a nested loop. Both sides get a
cell key no narrower than the radius, the probing side is exploded to its nine
neighbour cells, and the exact distance is a filter after the equi-join. Copies
of one coordinate are collapsed before the join and expanded after it, so a hot
spot that repeats a position costs one row; hot cells of distinct positions are
split by the adaptive skew join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footbridge.functions.geo import cell, cells_around, haversine, index_of, side_of, zoom_of
from footbridge.session import count_true, materialise

CELL = ["_zoom", "_row", "_col"]
ENDS = ["lat_i", "lon_i", "lat_j", "lon_j"]
CROWD = 32  # edges a cell of a ring's cover holds at most, unless it is very small


def radius_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """All pairs within ``radius_m``.

    Both sides need ``lat, lon``; their other columns must not clash. The result has
    every column, the right coordinates as ``r_lat, r_lon``, and ``dist_m``.
    """
    probe = left.where("lat is not null and lon is not null").withColumn(
        "_cell", F.explode(cells_around(F.col("lat"), F.col("lon"), radius_m))
    )
    index = right.where("lat is not null and lon is not null").withColumn(
        "_cell", cell(F.col("lat"), F.col("lon"), radius_m)
    ).withColumnRenamed("lat", "r_lat").withColumnRenamed("lon", "r_lon")
    return (
        probe.join(index, "_cell")
        .withColumn("dist_m", haversine("lat", "lon", "r_lat", "r_lon"))
        .where(F.col("dist_m") <= radius_m)
        .drop("_cell")
    )


def nearest(left: DataFrame, right: DataFrame, radius_m: float, tie: str) -> DataFrame:
    """The nearest right row of every left row within ``radius_m``; unmatched rows are dropped.

    ``tie`` is the right column that decides between equal distances (smallest wins).
    Repeated coordinates on either side are collapsed first.
    """
    left_cols = list(left.columns)
    right_cols = [c for c in right.columns if c not in ("lat", "lon")]
    spots = left.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    sites = (
        right.where("lat is not null and lon is not null").groupBy("lat", "lon")
        .agg(F.min_by(F.struct(*right_cols), F.col(tie)).alias("_site"))
    )
    best = (
        radius_join(spots, sites, radius_m)
        .groupBy("lat", "lon")
        .agg(F.min_by(
            F.struct("_site", "r_lat", "r_lon", "dist_m"), F.struct("dist_m", F.col(f"_site.{tie}"))
        ).alias("_best"))
    )
    return left.join(best, ["lat", "lon"]).select(
        *left_cols, *[F.col(f"_best._site.{c}").alias(c) for c in right_cols],
        F.col("_best.r_lat").alias("r_lat"), F.col("_best.r_lon").alias("r_lon"),
        F.col("_best.dist_m").alias("dist_m"),
    )


def _at_zooms(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` once for each zoom that ``cells`` use, with the key of their cell; there are some twenty zooms at most."""
    zooms = cells.agg(F.sort_array(F.collect_set("_zoom")).alias("zooms")).scalar()
    each = points.where("lat is not null and lon is not null").withColumn("_zoom", F.explode(zooms))
    return each.withColumns({"_row": index_of(F.col("lat"), F.col("_zoom")), "_col": index_of(F.col("lon"), F.col("_zoom"))})


def in_boxes(points: DataFrame, boxes: DataFrame, step_deg: float = 0.02) -> DataFrame:
    """Pairs of a point and a box holding it (bounds included).

    ``boxes`` need ``lat_lo, lat_hi, lon_lo, lon_hi``. A box lies in the few quadtree cells of its own size, whatever
    that is, and cells are no narrower than about ``step_deg``; points are matched at the zooms that boxes use.
    """
    extent = F.greatest(F.col("lat_hi") - F.col("lat_lo"), F.col("lon_hi") - F.col("lon_lo"))
    sized = boxes.withColumn("_zoom", zoom_of(extent, step_deg))
    for key, low, high in (("_row", "lat_lo", "lat_hi"), ("_col", "lon_lo", "lon_hi")):
        sized = sized.withColumn(key, F.explode(F.sequence(index_of(F.col(low), F.col("_zoom")), index_of(F.col(high), F.col("_zoom")))))
    return _at_zooms(points, sized).join(sized, CELL).where(
        "lat between lat_lo and lat_hi and lon between lon_lo and lon_hi"
    ).drop(*CELL)


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edge ``i`` runs from the previous vertex ``j`` to vertex ``i``; vertices are 0..n-1."""
    sizes = rings.groupBy("ring_id").agg((F.max("pos") + 1).alias("n"))
    here = rings.join(sizes, "ring_id").select(
        "ring_id", F.pmod(F.col("pos") - 1, F.col("n")).alias("prev"),
        F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"),
    )
    there = rings.select(
        "ring_id", F.col("pos").alias("prev"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j")
    )
    return here.join(there, ["ring_id", "prev"]).drop("prev")


def _turns(left: Column, top: Column, lat: Column, lon: Column) -> Column:
    """1 if an edge parts a place of a cell from the cell's upper left corner, else 0; null without an edge.

    A place is inside if an odd number of edges pass north of it. Going from the corner along the upper border, that
    number changes only by edges that cross the border; going down from there, only by edges passed on the way.
    """
    def spans(at: Column) -> Column:
        return (F.col("lon_i") > at) != (F.col("lon_j") > at)

    def height(at: Column) -> Column:
        run = F.nullif(F.col("lon_j") - F.col("lon_i"), F.lit(0.0))
        return (F.col("lat_j") - F.col("lat_i")) * (at - F.col("lon_i")) / run + F.col("lat_i")

    def beyond(at: Column) -> Column:
        return F.coalesce(spans(at) & (top < height(at)), F.lit(False))

    upper = F.when(F.col("lat_i") > top, F.col("lon_i")).otherwise(F.col("lon_j"))
    along = ((F.col("lat_i") > top) != (F.col("lat_j") > top)) & (((upper > left) & (upper <= lon)) != (beyond(lon) != beyond(left)))
    down = F.coalesce(spans(lon) & (lat < height(lon)), F.lit(False)) & ~beyond(lon)
    return (along != down).cast("int")


def _touches(zoom: Column, row: Column, col: Column) -> Column:
    """True if an edge may touch a cell: their boxes meet, and the cell's corners are not all on one side of the edge."""
    side = side_of(zoom)
    south, west = row * side, col * side
    rise, run = F.col("lat_j") - F.col("lat_i"), F.col("lon_j") - F.col("lon_i")
    off = run * (south + side / 2 - F.col("lat_i")) - rise * (west + side / 2 - F.col("lon_i"))
    return (
        (F.greatest("lat_i", "lat_j") >= south) & (F.least("lat_i", "lat_j") <= south + side)
        & (F.greatest("lon_i", "lon_j") >= west) & (F.least("lon_i", "lon_j") <= west + side)
        & (F.abs(off) <= (F.abs(rise) + F.abs(run)) * side * 0.500001 + 1e-12)
    )


def _split(edges: DataFrame) -> DataFrame:
    """The four quarters of every cell, with the edges that touch them.

    ``edges`` has ``ring_id, odd``, the quarters' ``_zoom`` and the ``_row, _col`` of the lower left one. Returns a row for each
    quarter and edge of it, and one without an edge for quarters that lie inside as a whole: ``ring_id``, the cell, ``odd`` (1 if its upper
    left corner is inside), ``held`` (its edges) and the edge's ends.
    """
    quarter = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)]))
    side = side_of(F.col("_zoom"))
    left, top = F.col("_col") * side, (F.col("_row") + 2) * side
    row, col = F.col("_row") + F.col("q.r"), F.col("_col") + F.col("q.c")
    quarters = edges.withColumn("q", quarter).select(
        "ring_id", "_zoom", row.alias("_row"), col.alias("_col"), *ENDS, F.col("odd").alias("was"),
        _turns(left, top, (row + 1) * side, col * side).alias("turn"), _touches(F.col("_zoom"), row, col).alias("touches"))
    cells = quarters.groupBy("ring_id", *CELL).agg(
        F.pmod(F.first("was") + F.sum("turn"), F.lit(2)).cast("int").alias("odd"), F.count_if("touches").alias("held"))
    kept = quarters.where("touches").drop("was", "turn", "touches").join(cells, ["ring_id", *CELL])
    return kept.unionByName(cells.where("held = 0 and odd = 1"), allowMissingColumns=True)


def ring_cover(rings: DataFrame, crowd: int = CROWD, step_deg: float = 0.02) -> DataFrame:
    """Quadtree cells that cover rings, as ``_split`` returns them.

    A ring starts with the four cells of its own size. Cells with more than ``crowd`` edges are quartered, round by round, down to
    a side of ``step_deg / 2 ** 12``. Cells inside carry no edge, cells outside are left out. Rings of few edges need no round.
    """
    edges = ring_edges(rings)
    boxes = rings.groupBy("ring_id").agg(
        F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
        F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"), F.count(F.lit(1)).alias("n"),
    ).where("n >= 3")
    # a little more than the extent, so that rounding can't make it three cells
    zoom = zoom_of(F.greatest(F.col("lat_hi") - F.col("lat_lo"), F.col("lon_hi") - F.col("lon_lo")) * 1.0001, step_deg)
    starts = boxes.withColumn("_zoom", zoom).select(
        "ring_id", "_zoom", index_of(F.col("lat_lo"), F.col("_zoom")).alias("_row"),
        index_of(F.col("lon_lo"), F.col("_zoom")).alias("_col"), F.lit(0).alias("odd"))
    last = math.floor(math.log2(step_deg)) - 12
    crowded = (F.col("held") > crowd) & (F.col("_zoom") > last)
    cover, rows = None, edges.join(starts, "ring_id")
    while True:
        table, seen = materialise(_split(rows), crowded=count_true(crowded))
        done = table.where(~crowded)
        cover = done if cover is None else cover.unionByName(done)
        if not seen["crowded"]:
            return cover
        rows = table.where(crowded).select(
            "ring_id", "odd", *ENDS, (F.col("_zoom") - 1).alias("_zoom"), (F.col("_row") * 2).alias("_row"), (F.col("_col") * 2).alias("_col"))


def points_in_rings(points: DataFrame, rings: DataFrame, point_key: str = "id", step_deg: float = 0.02, crowd: int = CROWD) -> DataFrame:
    """Points inside rings by counting crossings (lat as y, lon as x).

    ``rings`` has ``ring_id, pos, lat, lon``; the last vertex joins back to the first. ``point_key`` is unique. A point meets a ring
    in the one cell of the ring's cover that holds it: in an inner cell it's inside without a test, in another one only
    the few edges of that cell are looked at.
    """
    cover = ring_cover(rings, crowd, step_deg)
    side = side_of(F.col("_zoom"))
    turn = _turns(F.col("_col") * side, (F.col("_row") + 1) * side, F.col("lat"), F.col("lon"))
    met = _at_zooms(points.select(point_key, "lat", "lon"), cover).join(cover, CELL)
    return met.groupBy(point_key, "ring_id").agg(
        F.first("odd").alias("odd"), F.coalesce(F.sum(F.when(F.col("held") > 0, turn)), F.lit(0)).alias("turns"),
        F.first("lat").alias("lat"), F.first("lon").alias("lon"),
    ).where("(odd + turns) % 2 = 1").drop("odd", "turns")


def station_candidates(
    queries: DataFrame, stations: DataFrame, radius_m: float = 600.0, limit: int = 6
) -> DataFrame:
    """Up to ``limit`` stations per query, nearest first, where a query is a set of points.

    ``queries`` has ``query_id, lat, lon`` (one row per point); distance is the minimum over them.
    """
    index = stations.select("relation_id", "name", "lat", "lon")
    # the stations are the side that is repeated for neighbour cells; one shuffle by query serves all that follows
    pairs = radius_join(index, queries.select("query_id", "lat", "lon"), radius_m).select(
        "query_id", "relation_id", "name", "dist_m").repartition("query_id")
    per_station = pairs.groupBy("query_id", "relation_id").agg(
        F.min("dist_m").alias("dist_m"), F.first("name", ignorenulls=True).alias("name")
    )
    # overlapping relations share a centre up to the last bits of a mean: compare millimetres
    order = Window.partitionBy("query_id").orderBy(F.round("dist_m", 3), "relation_id")
    return per_station.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
