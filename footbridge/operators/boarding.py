"""Where a coach, a seat and a step-off point lie along a platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions.geo import haversine
from footbridge.operators import walks
from footbridge.operators.graph import PLAIN
from footbridge.session import cut


def sector_map(signs: DataFrame, platforms: DataFrame) -> DataFrame:
    """Sector spans of each platform (``platform, length_m``).

    ``signs`` has ``platform, sector`` and any of ``start_m, end_m`` (operator metres), ``sign_m``
    (sign position) and ``ord``. Metres win for the whole platform, else boundaries lie halfway
    between neighbouring signs, else the platform is divided equally in the given order.
    """
    per = Window.partitionBy("platform")
    s = signs.join(platforms, "platform").withColumn("sector", F.upper("sector")).withColumns({
        "metres": F.bool_and(F.col("start_m").isNotNull() & F.col("end_m").isNotNull()).over(per),
        "signed": F.bool_and(F.col("sign_m").isNotNull()).over(per), "n": F.count(F.lit(1)).over(per)})
    along = per.orderBy(F.coalesce("sign_m", F.col("ord").cast("double")), "sector")
    step = F.col("length_m") / F.col("n")
    k = F.row_number().over(per.orderBy("ord", "sector")) - 1
    prev, nxt = F.lag("sign_m").over(along), F.lead("sign_m").over(along)
    return s.withColumns({
        "lo": F.when(F.col("metres"), F.col("start_m")).when(F.col("signed"), F.coalesce((prev + F.col("sign_m")) / 2, F.lit(0.0))).otherwise(k * step),
        "hi": F.when(F.col("metres"), F.col("end_m")).when(F.col("signed"), F.coalesce((F.col("sign_m") + nxt) / 2, F.col("length_m"))).otherwise((k + 1) * step),
    }).select("platform", "sector", F.col("lo").alias("start_m"), F.col("hi").alias("end_m"))


def coach_spans(coaches: DataFrame, sectors: DataFrame, platforms: DataFrame) -> DataFrame:
    """Each coach's span on its platform: metres, else its sectors, else equal division by order.

    ``coaches`` has ``train_id, platform, coach, ord, sectors array, start_m, end_m, reversed``.
    Coaches that cannot be placed, or to no positive length, have no row.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("train_id", "platform"))
    c = coaches.withColumn("n", n).join(platforms, "platform")
    by_sector = c.where(F.size("sectors") > 0).select("train_id", "platform", "coach", F.explode("sectors").alias("sector")).withColumn(
        "sector", F.upper("sector")).join(sectors.select("platform", "sector", F.col("start_m").alias("s0"), F.col("end_m").alias("s1")),
                                          ["platform", "sector"], "left").groupBy("train_id", "platform", "coach").agg(
        F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.bool_and(F.col("s0").isNotNull()).alias("mapped"))
    has_map = sectors.select("platform").distinct().withColumn("has_map", F.lit(True))
    j = c.join(by_sector, ["train_id", "platform", "coach"], "left").join(has_map, "platform", "left")
    step = F.col("length_m") / F.col("n")
    pos = F.when(F.col("reversed"), F.col("n") - F.col("ord")).otherwise(F.col("ord") - 1)
    metres = F.col("start_m").isNotNull() & F.col("end_m").isNotNull()
    sector = (F.size("sectors") > 0) & F.coalesce("has_map", F.lit(False))
    return j.select(
        "train_id", "platform", "coach",
        F.when(metres, F.col("start_m")).when(sector, F.when(F.col("mapped"), F.col("s0"))).otherwise(pos * step).alias("start_m"),
        F.when(metres, F.col("end_m")).when(sector, F.when(F.col("mapped"), F.col("s1"))).otherwise((pos + 1) * step).alias("end_m"),
    ).where("start_m is not null and end_m > start_m")


def polylines(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``line, pos, node_id`` to vertices with cumulative metres and the line's length."""
    at = lines.join(nodes.where("lat is not null").select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    order = Window.partitionBy("line").orderBy("pos")
    gap = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    return at.withColumn("gap", F.coalesce(gap, F.lit(0.0))).withColumn(
        "cum", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "length_m", F.sum("gap").over(Window.partitionBy("line"))).drop("gap")


def _bracket(points: DataFrame, lines: DataFrame) -> DataFrame:
    """The segment of its line each ``line, offset_m`` falls on; offsets beyond an end are clamped."""
    order = Window.partitionBy("line").orderBy("pos")
    segs = lines.select(
        "line", "length_m", F.col("cum").alias("c0"), F.lead("cum").over(order).alias("c1"),
        F.col("node_id").alias("node_a"), F.lead("node_id").over(order).alias("node_b"),
        F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
        F.lead("lat").over(order).alias("b_lat"), F.lead("lon").over(order).alias("b_lon")).where("node_b is not null")
    # of the segments that begin at one offset the shortest stays, so a point falls on the one between its begin and the next;
    # a platform has a handful of vertices, so meeting its segments is a small equi-join
    parts = segs.groupBy("line", "c0").agg(F.min_by(F.struct(*[c for c in segs.columns if c not in ("line", "c0")]), F.struct("c1", "node_b")).alias("s"))
    begins = parts.select("line", "c0", F.lead("c0").over(Window.partitionBy("line").orderBy("c0")).alias("next_c0"), "s.*")
    inside = F.least(F.greatest(F.col("offset_m"), F.lit(0.0)), F.col("length_m"))
    return points.distinct().join(cut(begins), "line").withColumn("at_m", inside).where(
        "c0 <= at_m and (next_c0 is null or at_m < next_c0)").drop("next_c0")


def alighting_points(seats: DataFrame, spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Where each seat's passenger steps off: offset, coordinate, bracketing nodes, clamped flag.

    ``seats`` has ``seat_id, train_id, platform, coach, seat, seats_per_coach``; a seat sits in the
    middle of its share of the coach. ``lines`` comes from ``polylines`` with ``line`` = platform.
    """
    frac = (F.col("seat") - 0.5) / F.col("seats_per_coach")
    at = seats.where("seat between 1 and seats_per_coach").join(spans, ["train_id", "platform", "coach"]).select(
        "seat_id", F.col("platform").alias("line"), (F.col("start_m") + frac * (F.col("end_m") - F.col("start_m"))).alias("offset_m"))
    b = _bracket(at, lines)
    t = F.when(F.col("c1") == F.col("c0"), 0.0).otherwise((F.col("at_m") - F.col("c0")) / F.nullif(F.col("c1") - F.col("c0"), F.lit(0.0)))
    return b.select(
        "seat_id", F.col("line").alias("platform"), "offset_m",
        ((F.col("offset_m") < 0) | (F.col("offset_m") > F.col("length_m"))).alias("clamped"),
        (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * t).alias("lat"), (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * t).alias("lon"),
        "node_a", "node_b", ((F.col("at_m") - F.col("c0")) / M.WALK_SPEED).alias("to_a_s"), ((F.col("c1") - F.col("at_m")) / M.WALK_SPEED).alias("to_b_s"))


def coach_at(offsets: DataFrame, spans: DataFrame) -> DataFrame:
    """The coach one steps into at an offset: the earlier covering span, else the nearest edge.

    ``offsets`` has ``offset_id, train_id, platform, offset_m``.
    """
    off = F.col("offset_m")
    gap = F.when(off < F.col("start_m"), F.col("start_m") - off).when(off > F.col("end_m"), off - F.col("end_m")).otherwise(0.0)
    return offsets.join(spans, ["train_id", "platform"]).groupBy("offset_id").agg(
        F.min_by("coach", F.struct(gap.alias("gap"), "start_m", "coach")).alias("coach"))


def seat_walks(points: DataFrame, goals: DataFrame, edges: DataFrame, cutoff_s: float | None = None) -> DataFrame:
    """Walks that start at a seat's door: its two bracketing nodes with the seconds to reach them.

    ``points`` from ``alighting_points``; ``goals`` has ``goal_key, node_id`` and ``seat_id`` pairs come
    from ``points.goal_key``; without ``cutoff_s`` no walk is too long. Metres include the stretch along the platform.

    Without ``cutoff_s`` the search runs once per goal, against the edges, and all seats that ask for a goal share it: a
    station has a few goals and many seats. Seats meet the walks of their segment's two vertices in one row, and each adds its own
    stretch. A walk not found is then certainly disconnected, so ``reach_s`` is null. A seat and goal have one row.
    """
    starts = points.selectExpr("seat_id as start_key", "node_a as node_id", "to_a_s as start_s").unionByName(
        points.selectExpr("seat_id as start_key", "node_b as node_id", "to_b_s as start_s"))
    if cutoff_s is not None:
        asked = points.select(F.col("seat_id").alias("request_id"), F.col("seat_id").alias("start_key"), "goal_key", F.lit(cutoff_s).alias("cutoff_s"))
        return walks.shortest_walks(asked, starts, goals, edges).withColumnRenamed("request_id", "seat_id")
    back = edges.selectExpr(
        "dst as src", "dst_lv as src_lv", "src as dst", "src_lv as dst_lv", "seconds", "metres", "way_id", "to_pos as from_pos", "from_pos as to_pos")
    segments = cut(points.select("goal_key", "node_a", "node_b").distinct())
    targets = cut(segments.selectExpr("goal_key as search", "explode(array(node_a, node_b)) as node").distinct())
    seeds = goals.join(segments.select("goal_key").distinct(), "goal_key", "left_semi").select(
        F.col("goal_key").alias("search"), F.col("node_id").alias("node"), F.lit(0.0).alias("start_s"), F.lit(float("inf")).alias("limit_s"))
    state = walks.spread(cut(walks.adjacency(back)), seeds, goals=targets, with_origin=True)
    reached = cut(state.where(F.col("lv") == PLAIN).join(targets, ["search", "node"], "left_semi").selectExpr(
        "search as goal_key", "node", "struct(seconds, metres, origin) as onward"))
    for end in ("a", "b"):
        segments = segments.join(reached.withColumnsRenamed({"node": f"node_{end}", "onward": f"on_{end}"}), ["goal_key", f"node_{end}"], "left")

    def door(end: str) -> str:
        return (f"struct(to_{end}_s + on_{end}.seconds as seconds, on_{end}.origin as reached_node, "
                f"to_{end}_s * {M.WALK_SPEED}D + on_{end}.metres as metres)")

    met = points.join(segments.withColumnsRenamed({"node_a": "sa", "node_b": "sb", "goal_key": "sg"}), F.expr(
        "goal_key <=> sg and node_a <=> sa and node_b <=> sb"), "left")
    best = met.select("seat_id", "goal_key", F.expr(f"array_min(filter(array({door('a')}, {door('b')}), d -> d.seconds is not null)) as d")).groupBy(
        "seat_id", "goal_key").agg(F.min("d").alias("d"))
    found = F.col("d").isNotNull()
    return best.select(
        "seat_id", found.alias("found"), "d.seconds", "d.metres", "d.reached_node",
        F.when(~found, F.lit(M.DISCONNECTED)).alias("reason"), F.lit(None).cast("double").alias("reach_s"))


def stepoff(walk_starts: DataFrame, lines: DataFrame, goal_points: DataFrame) -> DataFrame:
    """Where to stand on the arriving train, oriented toward the departure platform.

    ``walk_starts`` has ``walk_id, line, node_id, goal``: the walk's first node on its arrival edge.
    ``goal_points`` has ``goal, lat, lon``. The fraction grows toward the connection.
    """
    centre = goal_points.groupBy("goal").agg(F.avg("lat").alias("g_lat"), F.avg("lon").alias("g_lon"))
    ends = lines.groupBy("line").agg(
        F.min_by(F.struct("lat", "lon"), "pos").alias("e0"), F.max_by(F.struct("lat", "lon"), "pos").alias("e1"))
    at = lines.groupBy("line", "node_id").agg(F.min("cum").alias("offset_m"), F.max("length_m").alias("length_m")).where("length_m > 0")
    j = walk_starts.join(at, ["line", "node_id"]).join(ends, "line").join(centre, "goal", "left")
    d0 = haversine("e0.lat", "e0.lon", "g_lat", "g_lon")
    d1 = haversine("e1.lat", "e1.lon", "g_lat", "g_lon")
    oriented = F.when(F.coalesce(d0 < d1, F.lit(False)), F.col("length_m") - F.col("offset_m")).otherwise(F.col("offset_m"))
    saved = F.greatest(F.col("o"), F.col("length_m") - F.col("o")) / M.WALK_SPEED
    return j.withColumn("o", oriented).withColumn("saved", saved).select(
        "walk_id", F.round("length_m", 1).alias("platform_length_m"), F.round("o", 1).alias("stepoff_offset_m"),
        F.round(F.col("o") / F.col("length_m"), 3).alias("stepoff_fraction"), F.round("saved", 1).alias("time_saved_s"),
        F.when(F.col("saved") >= M.BOARDING_HIGH_S, "high").when(F.col("saved") >= M.BOARDING_SOME_S, "some").otherwise("low").alias("significance"))
