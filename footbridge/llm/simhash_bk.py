"""SimHash near-duplicates by BK-trees.

A document's fingerprint takes the majority of its shingles' hashes bit by bit. Equal fingerprints are one node. Two
fingerprints that differ in at most r bits agree in whole on at least m - r of any m parts of their bits, so nodes are
sharded by every choice of parts that may agree: each node goes to C(m, r) shards, whatever the data, and no link
is lost. m is the least for which shards stay small on average.

A shard's fingerprints form a BK-tree: the child of a node stands under the Hamming distance to it. A query follows
only the edges whose label lies within the radius of its own distance to the node, and skips subtrees that are already
in its component, so that a large group of near copies costs little more than its size. All trees of a task are built
and searched together, level by level. A shard of more than ``SHARD`` nodes is cut into several trees; each of them is
sent to each block of the shard's queries. The trees of all shards grow with the corpus, so they travel with the
shuffle instead of a broadcast variable.

A tree search hands out a spanning forest of the links it finds, never all pairs. Components then come from large-star
and small-star rounds over these links, each round written to the shared folder.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like any other.
Repeated rows have equal fingerprints and so one component. Rows without doc_id get a fingerprint and null as
component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned
from footbridge.session import count_true, cut, materialise

SHINGLE = 4
RADIUS = 4
MEAN_SHARD = 512  # nodes a shard may hold on average before more parts are used
SHARD = 16384  # nodes of one tree
VISITS = 2_000_000  # visits of nodes by queries that one block of queries may make
TASK_NODES = 200_000  # nodes of the trees built at once
GROUP = ["shard", "piece", "block"]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # of bytes, these touch ASCII letters and the six separators only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(n)), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return pruned(docs, "doc_id", "text").select("doc_id", fp("text").alias("fp"))


def parts(n: int, radius: int) -> list[list[int]]:
    """Bit masks of the shards: every choice of m - radius of m parts."""
    m = radius + 1
    while m < 64 and n / 2 ** (64 * (m - radius) / m) > MEAN_SHARD:
        m += 1
    edges = [round(64 * i / m) for i in range(m + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, m - radius)]


class Forest:
    """The BK-trees of several groups. ``fp`` must be sorted by ``group``; a group's first fingerprint is its root."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, self.parent, self.label = fp, np.full(n, -1), np.zeros(n, dtype=np.uint8)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, dtype=np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        order = [first]
        at = self.root.copy()
        rest = np.ones(n, dtype=bool)
        rest[first] = False
        rest = np.flatnonzero(rest)
        while len(rest):
            label = np.bitwise_count(fp[rest] ^ fp[at[rest]])
            # the first of those that come to one node by one label becomes the child, the others go down to it
            _, lead, to = np.unique(at[rest] * 128 + label, return_index=True, return_inverse=True)
            child = rest[lead]
            self.parent[child], self.label[child] = at[child], label[lead]
            order.append(child)
            at[rest] = child[to]
            stay = np.ones(len(rest), dtype=bool)
            stay[lead] = False
            rest = rest[stay]
        self.levels = order
        inner = np.concatenate(order[1:]) if len(order) > 1 else np.zeros(0, dtype=np.int64)
        key = self.parent[inner] * 128 + self.label[inner]
        by_key = np.argsort(key, kind="stable")
        self.child_key, self.child = key[by_key], inner[by_key]

    def one_component(self, comp: np.ndarray) -> np.ndarray:
        """For each node the component of its whole subtree, or -1 if there are several."""
        only = comp.copy()
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            mixed = only[level] != comp[up]
            only[up[mixed]] = -1
        return only

    def links(self, query_fp: np.ndarray, query_root: np.ndarray, query_comp: np.ndarray, comp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of links between different components, by blocks of queries. Whoever reads may update both
        component arrays before the next block."""
        size = np.bincount(self.root, minlength=len(self.fp))[query_root]
        spent = np.r_[0, np.cumsum(size)]
        start = 0
        while start < len(query_fp):
            stop = max(start + 1, int(np.searchsorted(spent, spent[start] + VISITS)) - 1)
            q, start = np.arange(start, stop), stop
            node, only = query_root[q], self.one_component(comp)
            found = []
            while len(q):
                go = only[node] != query_comp[q]
                q, node = q[go], node[go]
                d = np.bitwise_count(query_fp[q] ^ self.fp[node]).astype(np.int64)
                hit = (d <= radius) & (comp[node] != query_comp[q])
                found.append((q[hit], node[hit]))
                low = np.searchsorted(self.child_key, node * 128 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.child_key, node * 128 + d + radius, side="right")
                n = high - low
                q = np.repeat(q, n)
                node = self.child[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if n.sum() else node[:0]
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def joined(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components after links a-b between them, each named by its least, and the indices of links that had to be."""
    up = {}

    def find(x: int) -> int:
        root = x
        while root in up:
            root = up[root]
        while x != root:
            up[x], x = root, up[x]
        return root

    used = []
    pair, first = np.unique(np.stack([comp[a], comp[b]], axis=1), axis=0, return_index=True) if len(a) else (np.zeros((0, 2), dtype=np.int64), [])
    for (x, y), i in zip(pair.tolist(), first, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            used.append(i)
    if up:
        names, back = np.unique(comp, return_inverse=True)
        comp = np.array([find(x) for x in names.tolist()], dtype=np.int64)[back]
    return comp, np.array(used, dtype=np.int64)


def tree_links(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links (a, b) of whole groups (shard, piece, block): the group's rows with tree are searched by those
    with ask."""
    rows = rows.sort_values(GROUP, kind="stable")
    group = rows.groupby(GROUP, sort=True).ngroup().to_numpy()
    fp, rep = rows.fp.to_numpy().view(np.uint64), rows.rep.to_numpy()
    tree_at = np.flatnonzero(rows.tree.to_numpy())
    trees, tree_group = Forest(group[tree_at], fp[tree_at]), group[tree_at]
    ask = np.flatnonzero(rows.ask.to_numpy())
    root = np.searchsorted(tree_group, group[ask])
    inside = root < len(tree_group)
    inside[inside] = tree_group[root[inside]] == group[ask[inside]]
    ask, root = ask[inside], root[inside]
    # a node has as many components as groups it is in; in each it starts alone
    comp = np.arange(len(rows))
    asking, asked, out = comp[ask], comp[tree_at], []
    for q, node in trees.links(fp[ask], root, asking, asked, radius):
        a, b = ask[q], tree_at[node]
        comp, used = joined(comp, a, b)
        asking[:], asked[:] = comp[ask], comp[tree_at]
        out.append(np.stack([rep[a[used]], rep[b[used]]], axis=1))
    links = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def sharded(nodes: DataFrame, masks: list[list[int]]) -> DataFrame:
    """Rows (shard, fp, rep), one a node and mask."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long"))) for i, m in enumerate(masks)])
    return nodes.select(F.explode(keys).alias("shard"), "fp", "rep")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of (fp, rep) whose fingerprints differ in at most ``radius`` bits."""
    rows = sharded(nodes, parts(nodes.count(), radius))
    # written, so that Spark knows its true size before it plans the join
    large = materialise(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD))[0]
    pieces = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / SHARD)).cast("int")
    rows = rows.join(large, "shard", "left").select("shard", "fp", "rep", F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k"))
    # piece i is searched by blocks 0 to i of its shard; a node is in its own piece and its own block
    rows = rows.select(
        "shard", F.greatest("own", "k").alias("piece"), F.least("own", "k").alias("block"),
        (F.col("k") <= F.col("own")).alias("tree"), (F.col("k") >= F.col("own")).alias("ask"), "fp", "rep",
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TASK_NODES:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows[GROUP] == rows[GROUP].iloc[-1]).all(axis=1)
            held = [rows[last]]
            if not last.all():
                yield tree_links(rows[~last], radius)
        if held:
            yield tree_links(pd.concat(held, ignore_index=True), radius)

    packed = rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return packed.mapInPandas(search, "a long, b long").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least) for every node of ``links`` (a, b): the least node reachable, by alternating star rounds."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges, seen = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), n=F.count(F.lit(1)))
    while seen["n"]:
        # large star: every greater neighbour moves to the least one
        pairs = edges.select(F.inline(both))
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: lesser neighbours and the node itself move to the least of them
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        small = moved.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))))
        after = small.where("a <> b").distinct().join(edges.withColumn("old", F.lit(True)), ["a", "b"], "left")
        n_before = seen["n"]
        edges, seen = materialise(after, n=F.count(F.lit(1)), new=count_true(F.col("old").isNull()))
        edges = edges.select("a", "b")
        if not seen["new"] and seen["n"] == n_before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))


def group_documents(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id reachable, for every document. Fingerprints are the nodes, so rows
    that share a doc_id link nothing by that."""
    marked = cut(fingerprints(docs, shingle))
    nodes = cut(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius))
    named = cut(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("least", "fp").alias("name")))
    least = named.groupBy("name").agg(F.min("least_id").alias("component_id"))
    label = F.when(F.col("m.doc_id").isNotNull(), F.col("n.component_id")).alias("component_id")
    return marked.alias("m").join(named.join(least, "name").alias("n"), "fp", "left").select("m.doc_id", "fp", label)
