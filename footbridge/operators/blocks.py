"""The search of ``walks.spread`` in blocks: the graph is cut into cells of bounded size, and a round settles whole blocks.

A round brings the rows of a search and block together with the edges of that block, follows them there to the end with a heap, and
hands on only offers over edges that leave the block. So rounds, and rows that are shuffled, grow with the blocks a walk crosses, not
with its junctions. Blocks are squares of the map, quartered until their edges are few; walks cross few of them wherever they lie,
and a bad cut costs rounds, never a result. Memory is bounded by one block's edges and the rows of ``SEARCHES`` searches in it.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.operators.graph import PLAIN
from footbridge.session import count_true, cut, materialise

EDGES = 8192  # edges of a block, at most
SEARCHES = 64  # searches that share a block's edges in one group, on average
FINEST = 0.00125  # degrees of the smallest square
LEVELS = 9  # sizes of squares, each twice the one before
IMPROVES = 1e-9
_KEY = ["search", "node", "lv"]


def blocks(edges: DataFrame, nodes: DataFrame, most: int = EDGES) -> DataFrame:
    """``node, block``: the largest square that holds a node and no more than ``most`` edges; the smallest are dealt by a hash."""
    ends = edges.selectExpr("src as node", "1 as n").unionByName(edges.selectExpr("dst as node", "0 as n"))
    at = ends.groupBy("node").agg(F.sum("n").alias("n")).join(
        nodes.where("lat is not null and lon is not null").groupBy(F.col("id").alias("node")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")), "node")
    at = cut(at.selectExpr("node", "n", f"cast(floor(lat / {FINEST}) as long) as y", f"cast(floor(lon / {FINEST}) as long) as x"))
    fine = at.groupBy("x", "y").agg(F.sum("n").alias("n"))
    squares = fine.select("x", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("k")).selectExpr(
        "x", "y", "n", "k", "shiftright(x, k) as cx", "shiftright(y, k) as cy")
    held = squares.groupBy("k", "cx", "cy").agg(F.sum("n").alias("held"))
    fits = squares.join(held, ["k", "cx", "cy"]).groupBy("x", "y").agg(
        F.max(F.when(F.col("held") <= most, F.col("k"))).alias("k"), F.min("held").alias("least"))
    block = ("if(k is null, concat_ws('/', x, y, pmod(xxhash64(node), cast(ceil(least / {m}) as long))), "
             "concat_ws('/', k, shiftright(x, k), shiftright(y, k)))").format(m=most)
    return at.join(fits, ["x", "y"]).select("node", F.expr(block).alias("block"))


def _placed(rows: DataFrame, of: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the block of a node; one without a position is in a block by its hash."""
    met = rows.join(of.selectExpr(f"node as {node}", f"block as {name}"), node, "left")
    return met.withColumn(name, F.coalesce(name, F.concat(F.lit("#"), F.pmod(F.xxhash64(node), F.lit(1024)))))


def _settler():
    """The function of a group, made here so that it is sent to the workers as a whole."""

    def settle(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        """Best rows that the offers (``fresh``) change in one block, and what they offer to vertices of other blocks (``out``)."""
        floor = lambda values: [None if v != v else v for v in values.tolist()]
        next_of: dict = {}
        for node, lv, *edge in zip(
            edges.src.tolist(), floor(edges.src_lv), edges.dst.tolist(), floor(edges.dst_lv), edges.to.tolist(),
            edges.seconds.tolist(), edges.metres.tolist(), edges.inside.tolist(), strict=True,
        ):
            if lv is not None and edge[3] == edge[3]:  # nothing leaves an unknown floor or takes an unknown time
                next_of.setdefault((node, lv), []).append(edge)
        made: list[tuple] = []
        rows = rows[rows.seconds.notna()]
        for search, mine in rows.groupby("search", sort=False):
            limit = mine.limit_s.max()
            best: dict = {}
            heap: list = []
            for node, lv, s, m, fresh in zip(mine.node.tolist(), floor(mine.lv), mine.seconds.tolist(), mine.metres.tolist(), mine.fresh.tolist(), strict=True):
                if fresh:
                    heap.append((s, m, node, lv))
                elif (node, lv) not in best or s < best[node, lv][0]:
                    best[node, lv] = (s, m)
            heap = [h for h in heap if h[2:] not in best or h[0] < best[h[2:]][0] - IMPROVES]
            heap.sort(key=lambda h: h[:2])
            heap = [(s, m, k, node, lv) for k, (s, m, node, lv) in enumerate(heap)]  # the number keeps floors from being compared
            count = len(heap)
            changed: dict = {}
            offers: dict = {}
            while heap:
                s, m, _, node, lv = heapq.heappop(heap)
                at = (node, lv)
                if at in changed or at in best and not s < best[at][0] - IMPROVES:
                    continue
                changed[at] = (s, m)
                if not s <= limit:
                    continue
                for dst, dst_lv, to, w, e_m, inside in next_of.get(at, ()):
                    there, cost = (dst, dst_lv), s + w
                    if not inside:
                        if there not in offers or cost < offers[there][0]:
                            offers[there] = (cost, m + e_m, to)
                    elif there not in changed and (there not in best or cost < best[there][0] - IMPROVES):
                        heapq.heappush(heap, (cost, m + e_m, count, dst, dst_lv))
                        count += 1
            made += [(search, n, v, s, m, limit, None) for (n, v), (s, m) in changed.items()]
            made += [(search, n, v, s, m, limit, to) for (n, v), (s, m, to) in offers.items()]
        out = pd.DataFrame(made, columns=[*_KEY, "seconds", "metres", "limit_s", "out"])
        out["block"] = key[0] if key else None
        return out

    return settle


def spread(edges: DataFrame, nodes: DataFrame, starts: DataFrame, goals: DataFrame | None = None, most: int = EDGES) -> DataFrame:
    """``walks.spread`` without paths and origins, over ``edges`` whose vertices lie at ``nodes`` (``id, lat, lon``).

    Of equally quick ways into a vertex of one block the shorter counts. ``starts`` and ``goals`` as there.
    """
    of = cut(blocks(edges, nodes, most))
    roads = edges.select("src", "src_lv", "dst", "dst_lv", "seconds", "metres").where("src_lv is not null and seconds is not null")
    roads = cut(_placed(_placed(roads, of, "src", "block"), of, "dst", "to").withColumn("inside", F.col("to") == F.col("block")))
    best = starts.groupBy("search", "node").agg(F.min("start_s").alias("seconds"), F.max("limit_s").alias("limit_s"))
    front = cut(_placed(best.selectExpr(
        "search", "node", f"cast({PLAIN} as double) as lv", "seconds", f"seconds * {M.WALK_SPEED}D as metres", "limit_s"), of, "node", "block"))
    kind = front.schema["search"].dataType.simpleString()
    schema = f"search {kind}, node bigint, lv double, seconds double, metres double, limit_s double, out string, block string"
    columns = [*_KEY, "seconds", "metres", "limit_s"]

    parts: list[DataFrame] = []
    while True:
        shares = cut(front.groupBy("block").agg(F.count_distinct("search").alias("n")).selectExpr(
            "block", f"cast(ceil(n / {SEARCHES}) as int) as shares"))
        rows = front.select(*columns, "block", F.lit(True).alias("fresh"))
        for part in parts:
            known = part.where("out is null").join(front.select("search", "block").distinct(), ["search", "block"], "left_semi")
            rows = rows.unionByName(known.select(*columns, "block", F.lit(False).alias("fresh")))
        rows = rows.join(shares, "block").withColumn("share", F.expr("pmod(xxhash64(search), shares)")).drop("shares")
        near = roads.join(shares, "block").select(
            "block", F.explode(F.expr("sequence(0L, shares - 1L)")).alias("share"), "src", "src_lv", "dst", "dst_lv", "to", "seconds", "metres", "inside")
        settled = rows.groupBy("block", "share").cogroup(near.groupBy("block", "share")).applyInPandas(_settler(), schema)
        settled, seen = materialise(settled, out=count_true(F.col("out").isNotNull()))
        parts.append(settled)
        if not seen["out"]:
            break
        # an offer moves on if it betters what is known of its vertex
        front = settled.where("out is not null").groupBy(*_KEY, F.col("out").alias("block")).agg(
            F.min("seconds").alias("seconds"), F.min_by("metres", F.struct("seconds", "metres")).alias("metres"), F.max("limit_s").alias("limit_s"))
        front, seen = materialise(front, n=F.count(F.lit(1)))
        if goals is not None:
            # only the searches that go on are asked for their dearest goal
            who = front.select("search").distinct()
            plain = [part.where((F.col("lv") == PLAIN) & F.col("out").isNull()).select("search", "node", "seconds") for part in parts]
            reached = reduce(DataFrame.unionByName, plain).join(who, "search", "left_semi").groupBy("search", "node").agg(F.min("seconds").alias("seconds"))
            bound = goals.join(who, "search", "left_semi").distinct().join(reached, ["search", "node"], "left").groupBy("search").agg(
                F.expr("if(count(seconds) = count(1), max(seconds), null) as bound"))
            front, seen = materialise(
                front.join(bound, "search", "left").where("bound is null or seconds < bound").drop("bound"), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
    table = reduce(DataFrame.unionByName, [part.where("out is null").select(*columns) for part in parts])
    if len(parts) == 1:
        return table
    return cut(table.groupBy(*_KEY).agg(
        F.min("seconds").alias("seconds"), F.min_by("metres", F.struct("seconds", "metres")).alias("metres"), F.max("limit_s").alias("limit_s")))
