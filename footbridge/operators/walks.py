"""Shortest walks for whole tables of requests.

A *search* is one set of start vertices; every request that starts there shares it. The
search table holds one row per (search, vertex) with the best seconds so far. One Spark job
takes the rows improved last time through several rounds of "offer my cost plus the edge to
every neighbour, keep the minimum per vertex", then merges them into the table. Only that
moving shell is shuffled per round, once, and not even that where the graph can be broadcast; the
table itself is shuffled once per job, and is written out after it, which bounds lineage and
lets Spark choose the next joins from real sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions.geo import haversine
from footbridge.operators import blocks
from footbridge.operators.graph import PLAIN
from footbridge.session import count_true, cut, materialise

# an offer must beat the known cost by more than this to count
IMPROVES = 1e-9
_KEY = ["search", "node", "lv"]
# vertices of a graph that is small enough to be broadcast; rows of a larger one lie by node
FEW = 65536
_PATH = "array<struct<way_id:bigint,from_pos:int,to_pos:int,node:bigint,lv:double>>"


def adjacency(edges: DataFrame) -> DataFrame:
    """One row per vertex with its outgoing edges; a vertex has as many as ways meet there."""
    out = F.expr("collect_list(struct(dst, dst_lv, seconds as w, metres as m, way_id, from_pos, to_pos))")
    return edges.groupBy(F.col("src").alias("node"), F.col("src_lv").alias("lv")).agg(out.alias("next"))


def _merge(rows: DataFrame, with_path: bool, also: str = "true", with_origin: bool = False) -> DataFrame:
    """The best row per vertex; ``fresh`` if it beats what was known (``known_s``) and ``also`` holds."""
    # plain doubles keep this a hash aggregate; only a wanted path needs the wider ordering,
    # where equal costs go to the known row so nothing flips between rounds
    order = "struct(seconds, coalesce(known_s, double('inf')))" if with_path else "struct(seconds, origin)" if with_origin else "seconds"
    carried = (["path"] if with_path else []) + (["origin"] if with_origin else [])
    picked = [f"min_by({c}, {order}) as {c}" for c in ["metres", *carried]]
    merged = rows.groupBy(*_KEY).agg(*[F.expr(e) for e in [
        "min(seconds) as seconds", *picked, "max(limit_s) as limit_s", "min(known_s) as known_s", f"{also} as also"]])
    return merged.selectExpr(
        *_KEY, "seconds", "metres", "limit_s", *carried,
        f"also and (known_s is null or seconds < known_s - {IMPROVES}D) as fresh")


def by_node(next_of: DataFrame, parts: int) -> DataFrame:
    """``adjacency`` with all floors of a node in one row, parted by node."""
    floors = F.collect_list(F.struct("lv", "next")).alias("floors")
    return next_of.repartition(parts, "node").groupBy("node").agg(floors)


def _round(
    shell: DataFrame, next_of: DataFrame, with_path: bool, with_origin: bool = False, parts: int | None = None,
) -> DataFrame:
    """Every row stays and, if improved and within its limit, offers to its neighbours.

    Rows and offers come out of one pass, so a chain of rounds reads each round once. With ``parts`` rows lie by node, and
    ``next_of`` comes from ``by_node``: the shuffle that brings a vertex's offers together also serves the next round's join.
    """
    same = ", origin" if with_origin else ""
    stay = "struct(node, lv, seconds, metres, seconds as known_s" + (", path" if with_path else "") + same + ")"
    hop = ", concat(path, array(struct(e.way_id, e.from_pos, e.to_pos, e.dst as node, e.dst_lv as lv))) as path"
    offer = (
        "transform(next, e -> struct(e.dst as node, e.dst_lv as lv, seconds + e.w as seconds, "
        "metres + e.m as metres, cast(null as double) as known_s" + (hop if with_path else "") + same + "))"
    )
    if parts is None:
        met = shell.join(next_of, ["node", "lv"], "left")
    else:
        here = F.expr("get(filter(floors, f -> f.lv = lv), 0).next").alias("next")
        met = shell.join(next_of, "node", "left").select(*shell.columns, here)
    rows = met.selectExpr(
        "search", "limit_s",
        f"explode(concat(array({stay}), if(fresh and seconds <= limit_s and next is not null, {offer}, array()))) as r",
    ).selectExpr("search", "limit_s", "r.*")
    return _merge(rows if parts is None else rows.repartition(parts, "node"), with_path, with_origin=with_origin)


def lanes(spark: SparkSession) -> int:
    """Partitions that keep all cores busy, or as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(
    next_of: DataFrame, starts: DataFrame, with_path: bool = False, goals: DataFrame | None = None,
    rounds_per_job: int = 8, max_rounds: int | None = None, with_origin: bool = False, few: int = FEW,
) -> DataFrame:
    """Cheapest seconds from every search's starts to every vertex up to its limit.

    ``next_of`` comes from ``adjacency``; ``starts`` has ``search, node, start_s, limit_s``. With ``goals``
    (``search, node``) a search that has reached all of them only follows vertices cheaper than its
    dearest goal, as weights are never negative. A vertex first offered beyond the limit is
    kept as the rim of the search but not walked on from; it is what tells a walk cut short by
    the limit from one that does not exist. ``with_origin`` adds the start vertex as ``origin``, of equally near ones the least.
    In a graph of more than ``few`` vertices rows lie by node between rounds, else by search.
    """
    columns = [*_KEY, "seconds", "metres", "limit_s", *(["path"] if with_path else []), *(["origin"] if with_origin else [])]
    table = starts.groupBy("search", "node").agg(
        F.min("start_s").alias("seconds"), F.max("limit_s").alias("limit_s")
    ).selectExpr(
        "search", "node", f"cast({PLAIN} as double) as lv", "seconds", f"seconds * {M.WALK_SPEED}D as metres",
        "limit_s", *([f"cast(array() as {_PATH}) as path"] if with_path else []), *(["node as origin"] if with_origin else []), "true as fresh",
    )
    table, shell, done = None, table, 0
    # rows of one search stay together, so where the graph is small enough to be broadcast the rounds of
    # a job need no shuffle between them; a given number keeps few starts from being put into one task
    parts = lanes(starts.sparkSession)
    large = next_of.limit(few + 1).count() > few
    around = by_node(next_of, parts) if large else next_of
    while True:
        shell = shell.repartition(parts, "node" if large else "search")
        for _ in range(rounds_per_job):
            shell = _round(shell, around, with_path, with_origin, parts if large else None)
        done += rounds_per_job
        if table is None:
            table = shell
        else:
            # only what the last round improved, and the table did not know, moves on
            known = table.selectExpr(*columns, "seconds as known_s", "false as fresh")
            offered = shell.selectExpr(*columns, "cast(null as double) as known_s", "fresh")
            table = _merge(known.unionByName(offered), with_path, "bool_or(fresh)", with_origin)
        moving = "fresh and seconds <= limit_s"
        table, seen = materialise(table, fresh=count_true(F.expr(moving)))
        if not seen["fresh"] or (max_rounds is not None and done >= max_rounds):
            return table
        shell = table.where(moving)
        if goals is not None:
            plain = table.where(F.col("lv") == PLAIN).select("search", "node", "seconds")
            bound = goals.join(plain, ["search", "node"], "left").groupBy("search").agg(
                F.expr("if(count(seconds) = count(1), max(seconds), null) as bound"))
            shell = shell.join(bound, "search", "left").where("bound is null or seconds < bound").drop("bound")


def walk_cutoff(sources: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The longest plausible walk per request: from the straight line between the platforms.

    ``sources``/``targets`` have ``request_id, node_id``. Both platforms are a few dozen nodes,
    so the pairs of one request stay small; the minimum is taken map-side.
    """
    at = nodes.where("lat is not null").select(F.col("id").alias("node_id"), "lat", "lon")
    a = sources.select("request_id", "node_id").distinct().join(at, "node_id").select(
        "request_id", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = targets.select("request_id", "node_id").distinct().join(at, "node_id").select(
        "request_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    straight = a.join(b, "request_id").groupBy("request_id").agg(
        F.min(haversine("a_lat", "a_lon", "b_lat", "b_lon")).alias("straight_m")
    )
    return straight.withColumn("cutoff_s", cutoff_seconds(F.col("straight_m")))


def cutoff_seconds(straight_m: Column) -> Column:
    return F.greatest(
        F.lit(M.PLAUSIBLE_FLOOR_S),
        straight_m / M.WALK_SPEED * M.PLAUSIBLE_DETOUR + M.PLAUSIBLE_SLACK_S,
    )


def shortest_walks(
    requests: DataFrame, starts: DataFrame, goals: DataFrame, edges: DataFrame,
    with_path: bool = False, rounds_per_job: int = 8, nodes: DataFrame | None = None,
) -> DataFrame:
    """The cheapest walk of every request, or why there is none.

    requests: ``request_id, start_key, goal_key, cutoff_s``
    starts:   ``start_key, node_id`` and optionally ``start_s``
    goals:    ``goal_key, node_id``

    Requests with the same ``start_key`` share one search, run to the largest of their cutoffs.
    Returns ``request_id, found, seconds, metres, reason, reach_s`` (and ``path``). On contracted
    edges ``disconnected`` is certain unless ``reach_s`` passes the cutoff: then an inner node of a
    chain may lie beyond it, and the request has to be asked again on the plain edges. With ``nodes``
    (``id, lat, lon``) walks without paths are searched in blocks of the map.
    """
    if "start_s" not in starts.columns:
        starts = starts.withColumn("start_s", F.lit(0.0))
    limits = requests.groupBy("start_key").agg(F.max("cutoff_s").alias("limit_s"))
    seeds = starts.join(limits, "start_key").select(
        F.col("start_key").alias("search"), F.col("node_id").alias("node"), "start_s", "limit_s"
    )
    in_blocks = nodes is not None and not with_path
    next_of = None if in_blocks else cut(adjacency(edges))
    wanted = cut(requests.select("start_key", "goal_key").distinct().join(
        goals.select("goal_key", "node_id").distinct(), "goal_key"
    ))
    targets = wanted.select(F.col("start_key").alias("search"), F.col("node_id").alias("node")).distinct()
    state = blocks.spread(edges, nodes, seeds, targets) if in_blocks else spread(next_of, seeds, with_path, targets, rounds_per_job)
    arrived = state.where(F.col("lv") == PLAIN).withColumnsRenamed({"search": "start_key", "node": "node_id"})
    order = F.struct("seconds", "node_id")
    best = wanted.join(arrived, ["start_key", "node_id"]).groupBy("start_key", "goal_key").agg(
        F.min("seconds").alias("seconds"), F.min_by("metres", order).alias("metres"),
        F.min_by("node_id", order).alias("reached_node"),
        *([F.min_by("path", order).alias("path")] if with_path else []),
    )
    # the rim tells a cut search from a finished one; the reach adds the longest edge out of it
    longest = edges.groupBy(F.col("src").alias("node"), F.col("src_lv").alias("lv")).agg(F.max("seconds").alias("out_s"))
    rim = state.join(longest, ["node", "lv"], "left").groupBy(F.col("search").alias("start_key")).agg(
        F.max("seconds").alias("rim_s"), F.max(F.col("seconds") + F.coalesce("out_s", F.lit(0.0))).alias("reach_s"))
    out = requests.join(best, ["start_key", "goal_key"], "left").join(rim, "start_key", "left")
    found = F.coalesce(F.col("seconds") <= F.col("cutoff_s"), F.lit(False))
    return out.select(
        "request_id", found.alias("found"),
        F.when(found, F.col("seconds")).alias("seconds"),
        F.when(found, F.col("metres")).alias("metres"),
        F.when(found, F.col("reached_node")).alias("reached_node"),
        *([F.when(found, F.col("path")).alias("path")] if with_path else []),
        F.when(found, F.lit(None).cast("string"))
        .when(F.coalesce(F.col("rim_s") > F.col("cutoff_s"), F.lit(False)), F.lit(M.EXCEEDED))
        .otherwise(F.lit(M.DISCONNECTED)).alias("reason"), "reach_s",
    )


def path_hops(walks: DataFrame) -> DataFrame:
    """A walk's path as rows ``request_id, hop, way_id, from_pos, to_pos, node``."""
    return walks.where("found").select(
        "request_id", F.posexplode("path").alias("hop", "h")
    ).select("request_id", "hop", "h.way_id", "h.from_pos", "h.to_pos", F.col("h.node").alias("node"))


def path_nodes(hops: DataFrame, ways: DataFrame) -> DataFrame:
    """Every node of a path in order, the inner nodes of contracted hops put back.

    Returns ``request_id, seq, node_id`` with floor changes at one node collapsed.
    """
    along = hops.where("way_id is not null").join(
        ways.select(F.col("id").alias("way_id"), "nodes"), "way_id"
    ).withColumn("inner", F.when(
        F.col("from_pos") < F.col("to_pos"),
        F.slice("nodes", F.col("from_pos") + 1, F.col("to_pos") - F.col("from_pos") + 1),
    ).otherwise(F.reverse(F.slice(
        "nodes", F.col("to_pos") + 1, F.col("from_pos") - F.col("to_pos") + 1))))
    steps = along.select(
        "request_id", "hop", F.posexplode("inner").alias("k", "node_id")
    ).unionByName(hops.where("way_id is null").select(
        "request_id", "hop", F.lit(1).alias("k"), F.col("node").alias("node_id")
    ))
    order = Window.partitionBy("request_id").orderBy("hop", "k")
    distinct = steps.withColumn("before", F.lag("node_id").over(order)).where(
        "before is null or before <> node_id"
    )
    return distinct.select("request_id", (F.row_number().over(order) - 1).alias("seq"), "node_id")


def path_summary(hops: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per walk: node count, metres along the nodes, and the distinct ways in walking order."""
    steps = path_nodes(hops, ways).join(
        nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id"
    )
    order = Window.partitionBy("request_id").orderBy("seq")
    gap = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    lengths = steps.withColumn("gap", gap).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("metres")
    )
    first_use = hops.where("way_id is not null").groupBy("request_id", "way_id").agg(F.min("hop").alias("hop"))
    # a path holds a few dozen ways, so the ordered list of one walk is small
    in_order = first_use.groupBy("request_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("hop", "way_id"))), lambda s: s["way_id"].cast("string")
    ), ",").alias("ways"))
    return lengths.join(in_order, "request_id", "left")


def simple_paths(
    edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int
) -> DataFrame:
    """All simple paths up to a hop count, with their cost: a cross-check for small subgraphs.

    ``starts``/``ends`` have ``search, node``. Each hop is one join; visited vertices are barred.
    """
    paths = starts.select(
        "search", "node", F.lit(PLAIN).alias("lv"), F.lit(0.0).alias("seconds"),
        F.array(F.struct("node", F.lit(PLAIN).alias("lv"))).alias("visited"),
    )
    found = []
    goal = ends.select("search", "node").distinct()
    for hop in range(max_hops + 1):
        found.append(paths.join(goal, ["search", "node"], "left_semi").where(
            F.col("lv") == PLAIN).select("search", "node", "seconds", F.lit(hop).alias("hops")))
        if hop == max_hops:
            break
        step = edges.select("src", "src_lv", "dst", "dst_lv", F.col("seconds").alias("w"))
        grown = paths.join(step, (F.col("node") == F.col("src")) & (F.col("lv") == F.col("src_lv"))).where(
            ~F.array_contains("visited", F.struct(F.col("dst").alias("node"), F.col("dst_lv").alias("lv")))
        )
        paths = cut(grown.select(
            "search", F.col("dst").alias("node"), F.col("dst_lv").alias("lv"),
            (F.col("seconds") + F.col("w")).alias("seconds"),
            F.concat("visited", F.array(F.struct(F.col("dst").alias("node"), F.col("dst_lv").alias("lv"))))
            .alias("visited"),
        ))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def way_hops(ways: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Fewest way-to-way changes between two ways, walking over shared nodes.

    ``starts`` has ``search, way_id``; ``goals`` has ``search, way_id``. Without ``max_hops`` every way that can be
    reached is. The graph stays
    bipartite (way, node, way ...), so no list of all way pairs of a node is ever built.
    """
    touch = ways.select(F.explode(F.array_distinct("nodes")).alias("node"), F.col("id").alias("way_id"))
    touch = cut(touch)
    seen = cut(starts.select("search", "way_id").distinct().withColumn("hops", F.lit(0)))
    seen_nodes = None
    front, hops = seen, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        nodes = front.select("search", "way_id").join(touch, "way_id").select("search", "node").distinct()
        if seen_nodes is not None:
            nodes = nodes.join(seen_nodes, ["search", "node"], "left_anti")
        nodes = cut(nodes)
        seen_nodes = nodes if seen_nodes is None else seen_nodes.unionByName(nodes)
        fresh = nodes.join(touch, "node").select("search", "way_id").distinct().join(
            seen, ["search", "way_id"], "left_anti").withColumn("hops", F.lit(hops))
        front, got = materialise(fresh, new=F.count(F.lit(1)))
        if not got["new"]:
            break
        seen = seen.unionByName(front)
    return goals.select("search", "way_id").distinct().join(seen, ["search", "way_id"])


def way_breakdown(path_ways: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length, seconds and type of each way of a path (``path_id, ord, way_id``).

    A way with a vertex of unknown position has length 0, as a whole.
    """
    from footbridge.functions import tags as tg
    from footbridge.operators.graph import way_segments

    at = nodes.select(F.col("id").alias("n"), "lat", "lon")
    used = ways.join(path_ways.select(F.col("way_id").alias("id")).distinct(), "id", "left_semi")
    gaps = (
        way_segments(used)
        .join(at.withColumnsRenamed({"n": "node_from", "lat": "a_lat", "lon": "a_lon"}), "node_from", "left")
        .join(at.withColumnsRenamed({"n": "node_to", "lat": "b_lat", "lon": "b_lon"}), "node_to", "left")
        .withColumn("gap", haversine("a_lat", "a_lon", "b_lat", "b_lon"))
    )
    length = gaps.groupBy("way_id").agg(
        F.when(F.count("gap") == F.count(F.lit(1)), F.sum("gap")).otherwise(F.lit(0.0)).alias("metres")
    )
    kind = F.coalesce(
        F.nullif(tg.tag("tags", "highway"), F.lit("")), F.nullif(tg.tag("tags", "railway"), F.lit("")),
        F.when(tg.tag("tags", "conveying").isNotNull(), F.lit("escalator")).otherwise(F.lit("path")),
    )
    info = used.select(
        F.col("id").alias("way_id"), kind.alias("type"), tg.speed("tags").alias("speed"), tg.penalty("tags").alias("penalty")
    )
    return path_ways.join(info, "way_id").join(length, "way_id", "left").select(
        "path_id", "ord", "way_id", "type",
        F.coalesce("metres", F.lit(0.0)).alias("metres"),
        (F.coalesce("metres", F.lit(0.0)) / F.col("speed") + F.col("penalty")).alias("seconds"),
    )


def breakdown_totals(breakdown: DataFrame) -> DataFrame:
    return breakdown.groupBy("path_id").agg(
        F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n_ways")
    )
