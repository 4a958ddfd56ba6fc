"""Shared borders of polygon rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge.session import count_true, cut, materialise


def prepare_rings(rings: DataFrame, bbox: tuple[float, float, float, float], min_area: float, precision: int = 3) -> DataFrame:
    """Rings touching the box, large enough, snapped to the grid, repeats dropped and closed.

    ``rings`` has ``ring_id, pos, x, y``, first vertex repeated at the end.
    """
    x0, y0, x1, y1 = bbox
    order = Window.partitionBy("ring_id").orderBy("pos")

    def shape(df: DataFrame, *more) -> DataFrame:
        cross = F.col("x") * F.lead("y").over(order) - F.lead("x").over(order) * F.col("y")
        return df.withColumn("cross", cross).groupBy("ring_id").agg(
            (F.abs(F.sum("cross")) / 2).alias("area"), F.count(F.lit(1)).alias("n"), *more)

    # each step is written, as the next ones read it more than once: else one task would sort the same rows some sixty times
    near = (F.col("b") >= x0) & (F.col("a") <= x1) & (F.col("d") >= y0) & (F.col("c") <= y1) & (F.col("n") >= 4)
    big = cut(shape(rings, F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).where(
        near & (F.col("area") >= min_area)).select("ring_id"))
    snapped = rings.join(big, "ring_id", "left_semi").withColumns({c: F.round(c, precision) for c in ("x", "y")})
    same = (F.lag("x").over(order) == F.col("x")) & (F.lag("y").over(order) == F.col("y"))
    thin = cut(snapped.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").select("ring_id", "pos", "x", "y"))
    # close a ring whose last vertex no longer meets its first
    ends = thin.groupBy("ring_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("f"), F.max_by(F.struct("x", "y"), "pos").alias("l"), F.max("pos").alias("p"))
    closing = ends.where("f <> l").select("ring_id", (F.col("p") + 1).alias("pos"), "f.x", "f.y")
    closed = cut(thin.unionByName(closing))
    solid = cut(shape(closed).where("area > 0 and n >= 4").select("ring_id"))
    return cut(closed.join(solid, "ring_id", "left_semi").select(
        "ring_id", (F.row_number().over(order) - 1).alias("pos"), "x", "y"))


def ring_hops(rings: DataFrame) -> DataFrame:
    """Edges between a ring's points ``pos`` and ``pos + 1``; positions count 0, 1, 2, ..."""
    after = rings.select("ring_id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return rings.select("ring_id", "pos", "x", "y").join(after, ["ring_id", "pos"])


def _edge_key(df: DataFrame) -> DataFrame:
    a, b = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))


def edge_owners(rings: DataFrame, bbox: tuple[float, float, float, float], eps: float = 1e-9) -> DataFrame:
    """Each undirected edge with its owners: one is coast, more a border; clip edges are neither."""
    x0, y0, x1, y1 = bbox
    owners = _edge_key(ring_hops(rings)).groupBy("lo", "hi").agg(F.sort_array(F.collect_set("ring_id")).alias("owners"))

    def on(axis: str, v: float):
        return (F.abs(F.col(f"lo.{axis}") - v) < eps) & (F.abs(F.col(f"hi.{axis}") - v) < eps)

    clip = on("x", x0) | on("x", x1) | on("y", y0) | on("y", y1)
    return owners.withColumn("kind", F.when(clip, "clip").when(F.size("owners") > 1, "border").otherwise("coast"))


def _traced(rings: DataFrame, owners: DataFrame) -> DataFrame:
    """``ring_id, start, ord, x, y, x2, y2, owners``: each edge's place in its arc, which starts at edge ``start``.

    List ranking by pointer doubling: every edge points to the one before it unless an arc starts there, and each
    round the pointers of all unfinished edges double their reach. So rounds grow with the logarithm of the longest
    arc, no task holds a ring, and unfinished pointers go to different edges, so no key is hot. A ring with one owner
    set throughout is an arc that starts at its first edge.
    """
    hops = _edge_key(ring_hops(rings)).join(owners.select("lo", "hi", "owners"), ["lo", "hi"]).select(
        "ring_id", "pos", "x", "y", "x2", "y2", "owners")
    hops = cut(hops)
    size = hops.groupBy("ring_id").agg(F.count(F.lit(1)).alias("edges"))
    behind = hops.select("ring_id", F.col("pos").alias("before"), F.col("owners").alias("owners_before"))
    linked = hops.join(size, "ring_id").withColumn("before", F.pmod(F.col("pos") - 1, F.col("edges"))).join(
        behind, ["ring_id", "before"]).withColumn("starts", F.col("owners") != F.col("owners_before"))
    uncut = linked.groupBy("ring_id").agg(F.bool_or("starts").alias("any_start"))
    first = linked.join(uncut, "ring_id").withColumn("done", F.col("starts") | (~F.col("any_start") & (F.col("pos") == 0)))
    state, seen = materialise(first.select(
        "ring_id", "pos", F.when(F.col("done"), F.col("pos")).otherwise(F.col("before")).alias("start"),
        F.when(F.col("done"), 0).otherwise(1).cast("long").alias("ord"), "done"), left=count_true(~F.col("done")))
    while seen["left"]:
        ahead = state.select("ring_id", F.col("pos").alias("start"), F.col("start").alias("start2"), F.col("ord").alias("ord2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(ahead, ["ring_id", "start"]).select(
            "ring_id", "pos", F.col("start2").alias("start"), (F.col("ord") + F.col("ord2")).alias("ord"), F.col("done2").alias("done"))
        state, seen = materialise(state.where("done").unionByName(moved), left=count_true(~F.col("done")))
    return hops.join(state.drop("done"), ["ring_id", "pos"]).drop("pos")


def arc_points(rings: DataFrame, owners: DataFrame) -> DataFrame:
    """Maximal runs of a ring's edges with one owner set, each kept once however often it is walked: a row a point.

    ``arc_key, owners, n_owners, n_points, seq, x, y``. Points go in the lesser of both directions: that of the first
    place where a point differs from its mirror image. The key is two 64-bit hashes over points and places, so copies
    meet without a whole arc in a row; of copies the least (ring, start) stays. ``rings`` has positions 0, 1, 2, ...
    and is closed, as ``prepare_rings`` returns it.
    """
    arc = ["ring_id", "start"]
    edges = cut(_traced(rings, owners))
    length = edges.groupBy(*arc).agg(F.count(F.lit(1)).alias("edges"))
    sized = edges.join(length, arc)
    ends = sized.where(F.col("ord") == F.col("edges") - 1).select(
        *arc, "owners", "edges", F.col("edges").alias("seq"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("p"))
    points = cut(sized.select(*arc, "owners", "edges", F.col("ord").alias("seq"), F.struct("x", "y").alias("p")).unionByName(ends))
    mirror = points.select(*arc, (F.col("edges") - F.col("seq")).alias("seq"), F.col("p").alias("m"))
    back = points.join(mirror, [*arc, "seq"]).where("p <> m").groupBy(*arc).agg(F.min_by(F.col("m") < F.col("p"), "seq").alias("turned"))
    turned = points.join(back, arc, "left").withColumn(
        "seq", F.when(F.coalesce("turned", F.lit(False)), F.col("edges") - F.col("seq")).otherwise(F.col("seq")))
    turned = cut(turned.select(*arc, "owners", "edges", "seq", "p.x", "p.y"))
    keyed = turned.groupBy(*arc, "owners", "edges").agg(
        F.bit_xor(F.xxhash64("seq", "x", "y")).alias("h1"), F.bit_xor(F.xxhash64("x", "y", "seq")).alias("h2"))
    kept = keyed.groupBy("owners", "edges", "h1", "h2").agg(F.min(F.struct(*arc)).alias("a")).select(
        "a.*", F.xxhash64("h1", "h2", "owners", "edges").alias("arc_key"))
    return turned.join(kept, arc).select(
        "arc_key", F.array_join(F.transform("owners", lambda r: r.cast("string")), ",").alias("owners"), F.size("owners").alias("n_owners"),
        (F.col("edges") + 1).cast("int").alias("n_points"), "seq", "x", "y")


def shared_arcs(points: DataFrame) -> DataFrame:
    """``arc_key, owners, n_points, n_owners, kind`` of ``arc_points``."""
    return points.where("seq = 0").select(
        "arc_key", "owners", "n_points", "n_owners", F.when(F.col("n_owners") > 1, "border").otherwise("coast").alias("kind"))
