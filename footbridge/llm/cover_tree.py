"""Exact top-k search by inner product with two cover trees.

Vectors are whole numbers. Rows of one vector stand for each other: only the k + 1 smallest ids of a vector can be
among anyone's k best others, so no more of them are indexed, however often a vector occurs. Pivots, taken from a
bounded sample, deal the indexed rows to shards of bounded size; each shard is a cover tree, kept as one row of a table.
Distinct query vectors form blocks with trees of their own.

A query tree and an index tree are descended together. With centres q and r and covering radii a and b, no score under a
pair of nodes exceeds q.r + a|r| + b|q| + ab; a pair goes if that is below the worst k-th score of the query group. Pairs
are taken from the best bound on, in batches. A block first meets a shard of its own pivot, which gives its k-th scores;
then it visits only the pivots whose whole ball can still hold something.

Defined results: vectors that are null, or hold a null or a component that isn't finite, neither ask nor answer. A
shorter vector counts as padded with zeros. Rows of one id and one vector count once. Scores beyond a long are held at
its limits. With fewer than k others, all are returned; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footbridge.session import materialise

BASE = 1.4  # a child's covering radius is its parent's divided by this
LEAF = 24
SHARD = 4096  # rows of an index tree, on average
BLOCK = 1024  # vectors of a query tree, on average
SAMPLE = 4096  # vectors that the pivots are chosen from
PIVOTS = 256
BATCH = 20_000  # pairs of nodes expanded at once
MOST = 2**63 - 1


def padded(vectors, width: int | None = None) -> np.ndarray:
    """A matrix of rows of any length."""
    width = max(map(len, vectors), default=0) if width is None else width
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:width]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    if most < 2**62:
        return np.einsum("ij,ij->i", a, b)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(u, v, strict=True)), -MOST), MOST) for u, v in zip(a, b, strict=True)], dtype=np.int64)


class CoverTree:
    """Nodes in arrays: centre, covering radius, range of children, range of points of the whole subtree.

    The children of a node lie within its radius and further from each other than their own covering radius."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        at = vectors.astype(np.float64)
        self.order = np.arange(len(ids))
        centre, radius, first, last, begin, end = [0], [0.0], [0], [0], [0], [len(ids)]
        todo = [0] if len(ids) else []
        while todo:
            node = todo.pop()
            a, b = begin[node], end[node]
            members = self.order[a:b]
            away = np.sqrt(((at[members] - at[centre[node]]) ** 2).sum(axis=1))
            radius[node] = float(away.max())
            if b - a <= LEAF or radius[node] == 0:
                continue
            reach = radius[node] / BASE
            left, groups, middle = members, [], centre[node]
            while len(left):
                near = np.sqrt(((at[left] - at[middle]) ** 2).sum(axis=1)) <= reach
                groups.append((middle, left[near]))
                left = left[~near]
                middle = left[0] if len(left) else -1
            first[node], place = len(centre), a
            for middle, group in groups:
                self.order[place : place + len(group)] = group
                centre.append(middle)
                radius.append(0.0)
                first.append(0)
                last.append(0)
                begin.append(place)
                place += len(group)
                end.append(place)
                todo.append(len(centre) - 1)
            last[node] = len(centre)
        most = int(np.abs(vectors).max(initial=0))
        kind = next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)  # trees are sent around
        self.ids, self.vectors = ids[self.order], vectors[self.order].astype(kind)
        self.middle = np.argsort(self.order)[np.array(centre)] if len(ids) else np.zeros(0, dtype=np.int64)
        self.radius, self.first, self.last, self.begin, self.end = (np.array(x) for x in (radius, first, last, begin, end))

    @property
    def centre(self) -> np.ndarray:
        return self.vectors[self.middle]


def search(queries: CoverTree, index: CoverTree, k: int, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Better the k best scores (descending; ties to smaller ids) and ids of each of ``queries``' points."""
    width = max(queries.vectors.shape[1], index.vectors.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    qv, rv = wide(queries.vectors).astype(np.int64), wide(index.vectors).astype(np.int64)
    qc, rc = wide(queries.centre).astype(np.float64), wide(index.centre).astype(np.float64)
    q_norm, r_norm = np.sqrt((qc**2).sum(axis=1)), np.sqrt((rc**2).sum(axis=1))
    best, who = best.copy(), who.copy()

    def bound(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        a, b = queries.radius[q], index.radius[r]
        size = (q_norm[q] + a) * (r_norm[r] + b)
        # the last term is more than all rounding of the sums before it
        return np.einsum("ij,ij->i", qc[q], rc[r]) + a * r_norm[r] + b * q_norm[q] + a * b + 1e-9 * size + 1e-6

    def worst() -> np.ndarray:
        """For each query node the least k-th score of its points."""
        return np.minimum.reduceat(np.append(best[:, -1].astype(np.float64), 0), np.stack([queries.begin, queries.end], axis=1).ravel())[::2]

    def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which range each place comes from, and the places."""
        n = end - begin
        of = np.repeat(np.arange(len(n)), n)
        return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]

    q, r = np.array([0]), np.array([0])
    limit = bound(q, r)
    need = worst()
    while len(q):
        alive = limit >= need[q]
        q, r, limit = q[alive], r[alive], limit[alive]
        if len(q) > BATCH:
            by = np.argpartition(-limit, BATCH)
        else:
            by = np.arange(len(q))
        now, later = by[:BATCH], by[BATCH:]
        a, b = q[now], r[now]
        q_leaf, r_leaf = queries.last[a] == 0, index.last[b] == 0
        done = q_leaf & r_leaf
        new_q, new_r = [], []
        split_q = ~q_leaf & (r_leaf | (queries.radius[a] >= index.radius[b]))
        for mine, tree, node, other, out, out_other in ((split_q, queries, a, b, new_q, new_r), (~done & ~split_q, index, b, a, new_r, new_q)):
            of, child = spread(tree.first[node[mine]], tree.last[node[mine]])
            out.append(child)
            out_other.append(other[mine][of])
        a, b = a[done], b[done]
        for start in range(0, len(a), 512):
            x, y = a[start : start + 512], b[start : start + 512]
            of, qp = spread(queries.begin[x], queries.end[x])
            of_pair, rp = spread(index.begin[y][of], index.end[y][of])
            qp = qp[of_pair]
            got = scores(qv[qp], rv[rp])
            good = got >= best[qp, -1]
            if good.any():
                qp, got, ids = qp[good], got[good], index.ids[rp[good]]
                touched, place = np.unique(qp, return_inverse=True)
                owner = np.concatenate([place, np.repeat(np.arange(len(touched)), k)])
                value, name = np.concatenate([got, best[touched].ravel()]), np.concatenate([ids, who[touched].ravel()])
                by = np.lexsort([name, -value, owner])
                rank = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
                top = by[rank < k]
                best[touched], who[touched] = value[top].reshape(-1, k), name[top].reshape(-1, k)
        if len(a):
            need = worst()
        fresh_q, fresh_r = np.concatenate(new_q), np.concatenate(new_r)
        q, r, limit = np.concatenate([fresh_q, q[later]]), np.concatenate([fresh_r, r[later]]), np.concatenate([bound(fresh_q, fresh_r), limit[later]])
    return best, who


def whole_vector(x: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null if the vector has none, a null or a component that isn't finite."""
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def sampled(kept: DataFrame, n: int) -> list[list[int]]:
    """The vectors of the ``SAMPLE`` rows of (vec_id, vec) with the least hashes, in that order, of ``n`` rows in all.

    The limit is met before rows go to the driver: collected in order, every partition would send as many rows."""
    low = F.xxhash64("vec").alias("low")
    few = kept.select(low, "vec_id", "vec")
    most = -(2**63) + int(2**64 * 4 * SAMPLE / n) if n > 4 * SAMPLE else None
    for part in ([few.where(F.col("low") <= most)] if most is not None else []) + [few]:
        chosen, seen = materialise(part.orderBy("low", "vec_id").limit(SAMPLE), n=F.count(F.lit(1)))
        if seen["n"] >= min(SAMPLE, n):
            break
    return [r.vec for r in sorted(chosen.collect(), key=lambda r: (r.low, r.vec_id))]


def choose_pivots(sample: list[list[int]], n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    at = padded(sample)
    if not len(at):
        return at
    chosen, away = [0], None
    while len(chosen) < min(n, len(at)):
        d = ((at - at[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1)
        away = d if away is None else np.minimum(away, d)
        if away.max() == 0:
            break
        chosen.append(int(away.argmax()))
    return at[chosen]


def sharded(points: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Trees (pivot, salt, tree, reach) of the rows (vec_id, vec): by nearest pivot, large groups cut by a hash.

    ``reach`` is the greatest distance of a row from its pivot."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        at = padded(list(vectors), pivots.shape[1]).astype(np.float64)
        p = pivots.astype(np.float64)
        return pd.Series(((p**2).sum(axis=1) - 2 * at @ p.T).argmin(axis=1), dtype="int32")

    placed = materialise(points.select("vec_id", "vec", nearest("vec").alias("pivot")))[0]
    n = {r.pivot: r.n for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    salts = F.array(*[F.lit(max(1, -(-n.get(p, 0) // size))) for p in range(len(pivots))])
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("vec", "vec_id"), F.get(salts, F.col("pivot"))).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors = padded(list(rows.vec))
        tree = CoverTree(vectors, rows.vec_id.to_numpy())
        width = max(vectors.shape[1], pivots.shape[1])
        apart = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))) - np.pad(pivots[key[0]], (0, width - pivots.shape[1]))
        return pd.DataFrame({"pivot": [key[0]], "salt": [key[1]], "tree": [pickle.dumps(tree)], "reach": [float(np.sqrt((apart.astype(np.float64) ** 2).sum(axis=1)).max())]})

    return materialise(salted.groupBy("pivot", "salt").applyInPandas(build, "pivot int, salt int, tree binary, reach double"))[0]


FOUND = "key long, vec_id long, score long"
LOW = -MOST  # where there is nothing yet


def top_k(points: DataFrame, asking: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best others of each row of (vec_id long, vec array<long>) with ``asking``."""
    points = materialise(points.where("vec is not null and vec_id is not null").select("vec_id", "vec", asking.alias("asks")))[0]
    by_id = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    kept = points.groupBy("vec", "vec_id").agg(F.lit(1).alias("one")).withColumn("place", by_id).where(F.col("place") <= k + 1).select("vec_id", "vec")
    kept = materialise(kept, n=F.count(F.lit(1)))
    # each query vector by the least id that asks with it
    asked = materialise(points.where("asks").groupBy("vec").agg(F.min("vec_id").alias("vec_id")))[0]
    pivots = choose_pivots(sampled(kept[0], kept[1]["n"] or 0), min(PIVOTS, 1 + 2 * (kept[1]["n"] or 0) // SHARD))
    index = sharded(kept[0], pivots, SHARD)
    # blocks lie around the first, most distant pivots: few large ones, as each meets many shards
    blocks = sharded(asked, pivots[: 1 + 2 * asked.count() // BLOCK], BLOCK)
    reach = {r.pivot: r.reach for r in index.groupBy("pivot").agg(F.max("reach").alias("reach")).collect()}  # at most PIVOTS rows

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """k-th scores from a shard of the block's own pivot, and the pivots still to visit."""
        for batch in batches:
            for pivot, salt, block, shard in zip(*(batch[c] for c in ("pivot", "salt", "tree", "shard")), strict=True):
                q = pickle.loads(block)
                best, who = np.full((len(q.ids), k + 1), LOW), np.full((len(q.ids), k + 1), MOST)
                best, who = search(q, pickle.loads(shard), k + 1, best, who)
                width = max(q.vectors.shape[1], pivots.shape[1])
                at, p = np.pad(q.vectors, ((0, 0), (0, width - q.vectors.shape[1]))).astype(np.float64), np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).astype(np.float64)
                norm = np.sqrt((at**2).sum(axis=1))
                state = pickle.dumps((best, who))
                for other, far in reach.items():
                    high = at @ p[other] + far * norm
                    if (high * (1 + 1e-9) + 1e-6 + 1e-9 * norm * np.sqrt((p[other] ** 2).sum()) >= best[:, -1]).any():
                        yield pd.DataFrame({"block": [pivot], "block_salt": [salt], "queries": [block], "state": [state], "pivot": [other]})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, block, state, shard in zip(*(batch[c] for c in ("own", "queries", "state", "shard")), strict=True):
                q, (best, who) = pickle.loads(block), pickle.loads(state)
                if own:  # searched before
                    key, out, ids = np.repeat(q.ids, k + 1), best.ravel(), who.ravel()
                    real = ids != MOST
                else:
                    better, names = search(q, pickle.loads(shard), k + 1, best, who)
                    key, out, ids = np.repeat(q.ids, k + 1), better.ravel(), names.ravel()
                    real = (ids != MOST) & ~(ids[:, None] == np.repeat(who, k + 1, axis=0)).any(axis=1)
                yield pd.DataFrame({"key": key[real], "vec_id": ids[real], "score": out[real]})

    shard = index.select("pivot", F.col("salt").alias("shard_salt"), F.col("tree").alias("shard"))
    # trees repeat, so files of them are far smaller than their rows, and a table that seems small enough would be broadcast by the driver
    started = blocks.join(shard.where("shard_salt = 0").hint("merge"), "pivot").select("pivot", "salt", "tree", "shard")
    visits = materialise(started.repartition(F.col("pivot"), F.col("salt")).mapInPandas(first, "block int, block_salt int, queries binary, state binary, pivot int"))[0]
    pairs = visits.join(shard.hint("merge"), "pivot").withColumn("own", (F.col("pivot") == F.col("block")) & (F.col("shard_salt") == 0))
    pairs = pairs.repartition("block", "block_salt", "pivot", "shard_salt").select("own", "queries", "state", "shard")
    found = pairs.mapInPandas(rest, FOUND)
    order = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id"))
    top = found.withColumn("place", order("key")).where(F.col("place") <= k + 1)
    named = points.where("asks").select("vec", F.col("vec_id").alias("query_id")).distinct().join(asked.select("vec", F.col("vec_id").alias("key")), "vec")
    others = named.select("query_id", "key").join(top, "key").where("vec_id <> query_id")
    ranked = others.withColumn("rank", order("query_id"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
