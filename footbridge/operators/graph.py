"""The walk graph as tables: adjacency, segments, levels, edges, footprints, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.geo import haversine, lat_margin, lon_margin
from footbridge.operators.spatial import in_boxes
from footbridge.session import cut, materialise

# the level value of a vertex that is not split by floor
PLAIN = -1.0e9


def node_ways(ways: DataFrame) -> DataFrame:
    """One row per (node, way): the adjacency in the form joins want."""
    return ways.select(
        F.explode(F.array_distinct("nodes")).alias("node_id"), F.col("id").alias("way_id")
    )


def node_way_ids(ways: DataFrame) -> DataFrame:
    """The adjacency as one sorted way list per node."""
    return node_ways(ways).groupBy("node_id").agg(
        F.sort_array(F.collect_set("way_id")).alias("way_ids")
    )


def way_segments(ways: DataFrame) -> DataFrame:
    """Consecutive node pairs in way order, taken from the array itself without a shuffle."""
    pairs = F.expr(
        "transform(sequence(0, size(nodes) - 2), i -> struct(i as pos, nodes[i] as node_from, nodes[i + 1] as node_to))"
    )
    return ways.where(F.size("nodes") >= 2).select(
        F.col("id").alias("way_id"), F.explode(pairs).alias("s")
    ).select("way_id", "s.pos", "s.node_from", "s.node_to")


def way_points(
    ways: DataFrame, nodes: DataFrame, *carry: Column, of_node: tuple[Column, ...] = ()
) -> DataFrame:
    """Every way vertex with its coordinate; vertices without one are left out.

    ``carry`` are columns of the way, ``of_node`` columns of the node.
    """
    exploded = ways.select(
        F.col("id").alias("way_id"), *carry, F.posexplode("nodes").alias("pos", "node_id")
    )
    located = nodes.where("lat is not null and lon is not null").select(
        F.col("id").alias("node_id"), "lat", "lon", *of_node
    )
    return exploded.join(located, "node_id")


def relation_closure(members: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Way and node members of every relation through nested relations, cycle-safe.

    Each round joins only the pairs found in the last one with the relation-to-relation rows.
    """
    nested = members.where("member_type = 'R'").select(
        F.col("relation_id").alias("inner"), F.col("member_ref").alias("child")
    ).distinct()
    leaves = members.where("member_type in ('W', 'N')").select(
        F.col("relation_id").alias("inner"), "member_type", "member_ref"
    )
    frontier = nested.select(F.col("inner").alias("relation_id"), F.col("child").alias("inner")).where(
        "relation_id <> inner"
    )
    reach, seen = materialise(frontier, new=F.count(F.lit(1)))
    frontier, rounds = reach, 0
    while seen["new"] and (max_rounds is None or rounds < max_rounds):
        step = (
            frontier.join(nested, "inner").select("relation_id", F.col("child").alias("inner"))
            .where("relation_id <> inner").distinct()
            .join(reach, ["relation_id", "inner"], "left_anti")
        )
        frontier, seen = materialise(step, new=F.count(F.lit(1)))
        reach = reach.unionByName(frontier)
        rounds += 1
    own = leaves.select(F.col("inner").alias("relation_id"), "member_type", "member_ref")
    through = reach.join(leaves, "inner").select("relation_id", "member_type", "member_ref")
    return own.unionByName(through).distinct()


def seed_nodes(closure: DataFrame, ways: DataFrame, only_walkable: bool) -> DataFrame:
    """Distinct (relation, node) of the closure: its nodes and the nodes of its ways."""
    direct = closure.where("member_type = 'N'").select("relation_id", F.col("member_ref").alias("node_id"))
    kept = ways.where(tg.is_walkable("tags")) if only_walkable else ways
    by_way = (
        closure.where("member_type = 'W'").select("relation_id", F.col("member_ref").alias("id"))
        .join(kept.select("id", "nodes"), "id")
        .select("relation_id", F.explode("nodes").alias("node_id"))
    )
    return direct.unionByName(by_way).distinct()


def station_boxes(
    closure: DataFrame, nodes: DataFrame, ways: DataFrame,
    pad_m: float = M.STATION_PAD_M, only_walkable: bool = True,
) -> DataFrame:
    """The padded bounding box of every relation's seed geometry.

    Routing seeds from walkable member ways only, the platform list from all of them.
    """
    seeds = seed_nodes(closure, ways, only_walkable).join(
        nodes.select(F.col("id").alias("node_id"), "lat", "lon").where("lat is not null"), "node_id"
    )
    box = seeds.groupBy("relation_id").agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"),
        F.min("lon").alias("c"), F.max("lon").alias("d"), F.avg("lat").alias("mid"),
    )
    dlat, dlon = F.lit(lat_margin(pad_m)), lon_margin(pad_m, F.col("mid"))
    return box.select(
        "relation_id", (F.col("a") - dlat).alias("lat_lo"), (F.col("b") + dlat).alias("lat_hi"),
        (F.col("c") - dlon).alias("lon_lo"), (F.col("d") + dlon).alias("lon_hi"),
    )


def station_footprint(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Ways with a vertex inside each station box; pass only the vertices of ways that matter."""
    return in_boxes(points.select("way_id", "lat", "lon"), boxes).select("relation_id", "way_id").distinct()


def walkable_closure(
    seeds: DataFrame, ways: DataFrame, nodes: DataFrame, boxes: DataFrame | None,
    max_rounds: int | None = None, keep_way: Column | None = None, seed_ways: DataFrame | None = None,
) -> DataFrame:
    """Walkable ways connected to each relation's seeds, growing only through nodes in its box.

    ``seeds`` has ``relation_id, node_id`` and ``boxes`` one box per relation (None: unbounded).
    ``seed_ways`` (``relation_id, way_id``) are known from the start, as round 0. A round is one join of the new nodes with the adjacency and one with the way vertices.
    """
    kept = ways.where(tg.is_walkable("tags") if keep_way is None else keep_way)
    # adjacency with the coordinate test of the box folded in
    adjacency = node_ways(kept).join(
        nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left"
    )
    adjacency = cut(adjacency)
    seen_nodes = seeds.select("relation_id", "node_id").distinct()
    frontier = cut(seen_nodes)
    known = None if seed_ways is None else cut(
        seed_ways.select("relation_id", "way_id").distinct().withColumn("round", F.lit(0))
    )
    seen_nodes, rounds = frontier, 0
    while max_rounds is None or rounds < max_rounds:
        near = frontier.join(adjacency, "node_id")
        if boxes is not None:
            near = near.join(boxes, "relation_id").where(
                "lat between lat_lo and lat_hi and lon between lon_lo and lon_hi"
            )
        fresh = near.select("relation_id", "way_id").distinct()
        if known is not None:
            fresh = fresh.join(known, ["relation_id", "way_id"], "left_anti")
        fresh, got = materialise(fresh.withColumn("round", F.lit(rounds + 1)), new=F.count(F.lit(1)))
        if not got["new"]:
            break
        known = fresh if known is None else known.unionByName(fresh)
        grown = (
            fresh.join(adjacency.select("way_id", "node_id"), "way_id").select("relation_id", "node_id")
            .distinct().join(seen_nodes, ["relation_id", "node_id"], "left_anti")
        )
        frontier = cut(grown)
        seen_nodes = seen_nodes.unionByName(frontier)
        rounds += 1
    if known is None:
        return seeds.sparkSession.createDataFrame([], "relation_id long, way_id long, round int")
    return known


# ---- levels and edges --------------------------------------------------------

def _levelled_points(
    ways: DataFrame, nodes: DataFrame, keep: DataFrame | None = None, uses: bool = False
) -> DataFrame:
    """Located way vertices with step, cumulative metres and floor.

    One join on the node and one window per way. What depends on the node alone (mechanism,
    use count, ``keep`` mark) is added while rows are still clustered by node.
    """
    levels = F.col("levels")
    points = way_points(
        ways.withColumn("levels", tg.parse_levels(tg.tag("tags", "level"))), nodes,
        F.element_at(levels, 1).alias("l0"), F.element_at(levels, -1).alias("l1"),
        F.size(levels).alias("floors"),
        tg.speed("tags").alias("speed"), tg.penalty("tags").alias("penalty"),
        tg.direction("tags").alias("dir"), tg.is_elevator("tags").alias("lift_way"),
        (F.size("nodes") - 1).alias("last_pos"),
        of_node=(tg.mechanism("tags").alias("mech"),),
    )
    if uses:
        points = points.withColumn("uses", F.count(F.lit(1)).over(Window.partitionBy("node_id")))
    if keep is not None:
        points = points.join(keep.select("node_id").distinct().withColumn("wanted", F.lit(True)), "node_id", "left")
    way = Window.partitionBy("way_id")
    order = way.orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measured = points.select(
        "*", F.lag("lat").over(order).alias("lat0"), F.lag("lon").over(order).alias("lon0"),
        F.coalesce(F.lag("pos").over(order) == F.col("pos") - 1, F.lit(False)).alias("joined"),
    ).withColumn("step", F.coalesce(haversine("lat0", "lon0", "lat", "lon"), F.lit(0.0))).drop("lat0", "lon0")
    summed = measured.select(
        "*", F.sum("step").over(so_far).alias("cum"),
        F.sum(F.when(F.col("joined"), F.col("step") / F.col("speed") + F.col("penalty")).otherwise(0.0))
        .over(so_far).alias("cum_s"),
        F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(so_far).alias("breaks"),
        F.sum("step").over(whole).alias("total"), F.count(F.lit(1)).over(whole).alias("present"),
        F.lead("joined").over(order).alias("next_joined"),
    )
    floor = F.when((F.col("floors") == 1) | (F.col("present") == 1), F.col("l0")).otherwise(
        F.col("l0") + (F.col("l1") - F.col("l0"))
        * (F.col("cum") / F.when(F.col("total") == 0.0, F.lit(1.0)).otherwise(F.col("total")))
    )
    return summed.withColumn("floor", floor)


def way_node_levels(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The floor of every located way vertex, linear in distance on a multi-level way.

    A node repeated on a way has the floor of its last occurrence.
    """
    return _levelled_points(ways, nodes).groupBy("way_id", "node_id").agg(
        F.max_by("floor", "pos").alias("level")
    )


def _vertices(
    ways: DataFrame, nodes: DataFrame, keep: DataFrame | None = None, uses: bool = False
) -> DataFrame:
    """``_levelled_points`` with each vertex's graph level: its floor at a mechanism, else PLAIN."""
    last = Window.partitionBy("way_id", "node_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return _levelled_points(ways, nodes, keep, uses).withColumn("level", F.last("floor").over(last)).withColumn(
        "lv", F.when(F.col("mech").isNotNull(), F.col("level")).otherwise(F.lit(PLAIN))
    )


def _directed(hops: DataFrame) -> DataFrame:
    """The directed edges of each hop in one pass: forward and backward as the way allows.

    A search may also start on a mechanism node as a plain vertex and leave on any floor, so an
    edge out of such a node appears once more from its plain vertex.
    """
    plain = f"cast({PLAIN} as double)"

    def end(src: str, src_lv: str, dst: str, dst_lv: str, pos: str, to: str) -> str:
        return (f"named_struct('src', {src}, 'src_lv', {src_lv}, 'dst', {dst}, 'dst_lv', {dst_lv}, "
                f"'from_pos', {pos}, 'to_pos', {to}, 'legal', ")

    split = f"<> {plain}"
    made = F.expr(f"""array(
        {end('a', 'a_lv', 'b', 'b_lv', 'pos', 'b_pos')} dir >= 0),
        {end('b', 'b_lv', 'a', 'a_lv', 'b_pos', 'pos')} dir <= 0),
        {end('a', plain, 'b', 'b_lv', 'pos', 'b_pos')} dir >= 0 and a_lv {split}),
        {end('b', plain, 'a', 'a_lv', 'b_pos', 'pos')} dir <= 0 and b_lv {split}))""")
    return hops.select(F.explode(made).alias("e"), "seconds", "metres", "way_id", "lift").where("e.legal").select(
        "e.src", "e.src_lv", "e.dst", "e.dst_lv", "seconds", "metres", "way_id", "e.from_pos", "e.to_pos", "lift")


def vertical_edges(ports: DataFrame) -> DataFrame:
    """All ordered level pairs of a node-mapped mechanism, priced by its kind.

    ``ports`` has ``node_id, mech, level``.
    """
    a = ports.select("node_id", "mech", F.col("level").alias("a_lv")).distinct()
    b = ports.select("node_id", F.col("level").alias("b_lv")).distinct()
    return a.join(b, "node_id").where("a_lv <> b_lv").select(
        F.col("node_id").alias("src"), F.col("a_lv").alias("src_lv"),
        F.col("node_id").alias("dst"), F.col("b_lv").alias("dst_lv"),
        tg.climb_seconds(F.col("mech"), F.col("a_lv") - F.col("b_lv")).alias("seconds"),
        F.lit(0.0).alias("metres"), F.lit(None).cast("long").alias("way_id"),
        F.lit(None).cast("int").alias("from_pos"), F.lit(None).cast("int").alias("to_pos"),
        (F.col("mech") == "elevator").alias("lift"),
    )


def node_ports(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The floors each mechanism node is reached on."""
    return _vertices(ways.where(tg.is_walkable("tags")), nodes).where("mech is not null").select(
        "node_id", "mech", "level"
    ).distinct()


def walk_edges(
    ways: DataFrame, nodes: DataFrame, keep: DataFrame | None = None, contract: bool = False,
) -> DataFrame:
    """Directed, time-weighted edges of the walkable ways, vertical edges included.

    With ``contract`` only vertices where a walk can turn remain: shared nodes, way ends,
    mechanisms and the ``keep`` nodes (``node_id``). The chain between two of them becomes one
    edge carrying the summed seconds and metres and the way positions it spans, so the search
    needs one round per junction instead of one per mapped node.
    """
    points = _vertices(ways.where(tg.is_walkable("tags")), nodes, keep if contract else None, contract)
    order = Window.partitionBy("way_id").orderBy("pos")
    if contract:
        wanted = F.coalesce("wanted", F.lit(False)) if keep is not None else F.lit(False)
        points = points.where(
            (F.col("uses") > 1) | (F.col("pos") == 0) | (F.col("pos") == F.col("last_pos"))
            | F.col("mech").isNotNull() | wanted
            | ~F.col("joined") | ~F.coalesce("next_joined", F.lit(False))
        )
    hops = points.select(
        "way_id", "pos", "dir", F.col("lift_way").alias("lift"),
        F.col("node_id").alias("a"), F.col("lv").alias("a_lv"),
        F.lead("node_id").over(order).alias("b"), F.lead("lv").over(order).alias("b_lv"),
        F.lead("pos").over(order).alias("b_pos"),
        (F.lead("cum_s").over(order) - F.col("cum_s")).alias("seconds"),
        (F.lead("cum").over(order) - F.col("cum")).alias("metres"),
        (F.lead("breaks").over(order) - F.col("breaks")).alias("broken"),
    ).where("b is not null and broken = 0")
    ports = points.where("mech is not null").select("node_id", "mech", "level")
    return _directed(hops).unionByName(vertical_edges(ports))


def apply_profile(
    edges: DataFrame, step_free: bool = False, bridges: DataFrame | None = None,
) -> DataFrame:
    """A routing profile: without lifts, with stitch bridges, or both.

    ``bridges`` has ``node_a, node_b, dist_m`` and is walked both ways at walking speed.
    """
    out = edges.where(~F.col("lift")) if step_free else edges
    if bridges is not None:
        both = bridges.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "dist_m").unionByName(
            bridges.select(F.col("node_b").alias("src"), F.col("node_a").alias("dst"), "dist_m")
        )
        # a bridge can be taken from every floor of its start
        floors = edges.where(F.col("src_lv") != PLAIN).select("src", "src_lv").distinct()
        starts = both.withColumn("src_lv", F.lit(PLAIN)).unionByName(both.join(floors, "src").select(
            "src", "dst", "dist_m", "src_lv"
        ))
        out = out.unionByName(starts.select(
            "src", "src_lv", "dst", F.lit(PLAIN).alias("dst_lv"),
            (F.col("dist_m") / M.WALK_SPEED).alias("seconds"), F.col("dist_m").alias("metres"),
            F.lit(None).cast("long").alias("way_id"), F.lit(None).cast("int").alias("from_pos"),
            F.lit(None).cast("int").alias("to_pos"), F.lit(False).alias("lift"),
        ))
    return out
