"""Near copies by SimHash links and, for what these leave apart, by an exact join of word shingles; no pair is lost.

First the BK-trees of ``simhash_bk`` link texts whose fingerprints are near. A link counts if the whole sets of shingles
are similar, so a near fingerprint alone removes nothing. Fingerprints of similar texts may also lie far apart; the texts
of different components that are left meet in a join with prefix filters.

A text is the set of the hashes of its five-word shingles. Two sets with a similarity of t or more share one of the first
n - ceil(t n) + 1 members of each, whatever order all sets are put in. So texts meet on these members only, and each pair
that can still reach the similarity from the shared member on is confirmed on the whole sets. The order puts shingles that a sample of texts finds common last and goes by
hash otherwise; it decides how many pairs meet, never which pairs are confirmed.

Equal sets are one node. No pair is confirmed twice. Of the texts that share a member, each first meets one of another component, in rounds with
changing choice, so that a large group of near copies becomes one component by about as many pairs as it has texts. Then
only pairs of different components are left to meet, and all of them do.

Defined results: rows are told apart by doc_id and text, and the first row of a component stays: the least doc_id, rows
without one last, then the least xxhash64 of the text. Rows that agree in both are repeats, one of them stays. A null text
counts as empty; texts without words are one component; texts of fewer words than a shingle have one, of all their words.
Letters A-Z count as a-z. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from footbridge.llm.columns import fresh, pruned
from footbridge.llm.simhash_bk import components, majority
from footbridge.llm.simhash_bk import links as tree_links_of
from footbridge.session import count_true, cut, materialise

SHINGLE = 5
NUM, DEN = 4, 5  # least similarity
SAMPLE = 8192  # texts that tell common shingles, at least
SHARE = 8  # and one text in so many: a smaller share would let the texts that meet on one shingle grow with the table
COMMON = 3  # texts of the sample that a common shingle is in
MOST_COMMON = 262144  # shingles that the order puts last
GAIN = 10  # rounds end when fewer than one pair in so many is confirmed
TRIES = 16  # pairs of two components that are tried before all of them are


def hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()  # of bytes, these touch ASCII letters and the six separators only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + width]), 42) for i in range(n)), dtype=np.uint64, count=n)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text).view(np.int64))


def prefix(members: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, bool, int]:
    """The members of which two similar sets share one, and the place of the last of them in the order."""
    n = len(members)
    if not n:
        return members, False, 0
    at = np.searchsorted(common, members)
    late = common[np.minimum(at, len(common) - 1)] == members if len(common) else np.zeros(n, dtype=bool)
    first = np.concatenate([members[~late], members[late]])[: n - -(-NUM * n // DEN) + 1]
    return first, len(first) > n - late.sum(), first[-1]


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart, in the order that decides which one stays."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.struct(docs["doc_id"].isNull().alias("absent"), F.coalesce(docs["doc_id"], F.lit(0)).alias("id"), F.xxhash64(text).alias("text"))


@F.pandas_udf(ArrayType(LongType()))
def _members(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t) for t in texts], dtype=object)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles in several texts of a sample."""
    text = pruned(docs, "text").where("text is not null")
    part = text.where(F.pmod(F.xxhash64("text"), F.lit(max(1, min(SHARE, text.count() // SAMPLE)))) == 0).distinct()
    times = part.select(F.explode(_members("text")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.h for r in times.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], dtype=np.int64))


def described(docs: DataFrame) -> DataFrame:
    """row, the digest and the size of its set, the fingerprint, and the set's prefix and where that ends."""
    common = common_shingles(docs)

    @F.pandas_udf("whole binary, n int, fp long, prefix array<long>, late boolean, last long")
    def describe(texts: pd.Series) -> pd.DataFrame:
        sets, marks = [], []
        for text in texts:
            made = hashes(text)
            marks.append(majority(made))
            sets.append(np.unique(made.view(np.int64)))
        firsts = [prefix(s, common) for s in sets]
        columns = {"whole": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "fp": np.array(marks, dtype=np.uint64).view(np.int64)}
        return pd.DataFrame(columns | {k: [f[i] for f in firsts] for i, k in enumerate(("prefix", "late", "last"))})

    rows = pruned(docs, "doc_id", "text").select(row_key(docs).alias("row"), describe("text").alias("d"))
    return rows.select("row", "d.*")


def once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One of the rows of each key; only those of ``repeated`` keys have to meet for that."""
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "row", "left_anti").unionByName(rows.join(repeated, "row", "left_semi").dropDuplicates(["row"]))


def confirmed(pairs: DataFrame, lean: DataFrame, docs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, dict]:
    """The pairs (a, b) that are similar, and how many of how many they are.

    Where one prefix ends first, all common members up to there are in both prefixes, and of the others there are no more
    than that set has left. Pairs that can't reach the similarity so are settled without their whole sets."""
    of = lambda k, t: t.select(*[F.col(c).alias(k if c == "row" else f"{c}_{k}") for c in t.columns])
    lean = cut(lean.join(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi"))
    both = pairs.join(of("a", lean), "a").join(of("b", lean), "b")
    most = F.size(F.array_intersect("shared_a", "shared_b")) + F.when(F.col("end_a") <= F.col("end_b"), F.col("left_a")).otherwise(F.col("left_b"))
    open_, seen = materialise(both.select("a", "b", ((NUM + DEN) * most >= NUM * (F.col("n_a") + F.col("n_b"))).alias("open")), n=F.count(F.lit(1)), open=count_true(F.col("open")))
    open_ = open_.where("open").select("a", "b")
    if not seen["open"]:
        return open_, seen | {"near": 0}
    rows = cut(open_.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    texts = docs.select(row_key(docs).alias("row"), docs["text"]).join(rows, "row", "left_semi")
    texts = once(texts, cut(repeated.join(rows, "row", "left_semi")))
    sets = cut(texts.select("row", _members("text").alias("members")))
    both = open_.join(of("a", sets), "a").join(of("b", sets), "b")
    same = F.size(F.array_intersect("members_a", "members_b"))
    near = (NUM + DEN) * same >= NUM * (F.size("members_a") + F.size("members_b"))
    judged, of_open = materialise(both.select("a", "b", near.alias("near")), near=count_true(F.col("near")))
    return judged.where("near").select("a", "b"), seen | of_open


def in_components(held: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return held.withColumn("least", F.col("row"))
    return held.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("least", F.coalesce("least", "row"))


def near_fingerprints(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal, or linked by the BK-trees, of texts with words."""
    own = cut(marked.where("n > 0").join(nodes, "row", "left_semi").select("row", "fp").distinct())
    first = cut(own.groupBy("fp").agg(F.min("row").alias("first")))
    equal = own.join(first, "fp").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    linked = tree_links_of(first.select("fp", F.col("fp").alias("rep")))
    of = lambda k: first.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(k))
    linked = linked.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of("a"), "fp_a").join(of("b"), "fp_b")
    return equal.unionByName(linked.select("a", "b"))


def similar(docs: DataFrame, marked: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, least) of every node with a similar one: the least row reachable."""
    own = once(marked.join(nodes, "row", "left_semi"), repeated)
    held = own.select("row", "n", F.posexplode("prefix").alias("at", "member")).select("row", "n", (F.col("n") - F.col("at")).alias("rest"), "member")
    shared = held.groupBy("member").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    held = cut(held.join(shared.select("member"), "member", "left_semi"))
    left = F.ceil(NUM * F.col("n") / DEN).cast("int") - 1
    ends = own.select("row", "n", left.alias("left"), F.struct("late", "last").alias("end"))
    lean = cut(held.groupBy("row").agg(F.collect_list("member").alias("shared")).join(ends, "row"))
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    asked = cut(near_fingerprints(marked, nodes).select(low, high).distinct())
    near, seen = confirmed(asked, lean, docs, repeated)
    links, found, turn = (near, cut(components(near)), 0) if seen["near"] else (None, None, 0)
    # the first member that two sets share leaves either no more common ones than it has from there on
    reaches = (NUM + DEN) * F.least("rest", "rest_b") >= NUM * (F.col("n") + F.col("n_b"))
    while True:
        placed = in_components(held, found)
        chosen = F.min(F.struct(F.xxhash64("least", F.lit(turn)), F.col("least").alias("least"), F.col("row").alias("row"), F.col("n").alias("n"), F.col("rest").alias("rest"))).alias("one")
        ones = placed.groupBy("member").agg(F.min("least").alias("low"), F.max("least").alias("high"), chosen).where("low <> high")
        ones = cut(ones.select("member", F.col("one.row").alias("b"), F.col("one.least").alias("least_b"), F.col("one.n").alias("n_b"), F.col("one.rest").alias("rest_b")))
        pairs = placed.join(ones, "member").where((F.col("least") != F.col("least_b")) & reaches)
        pairs = cut(pairs.select(F.col("row").alias("a"), "b").select(low, high).distinct().join(asked, ["a", "b"], "left_anti"))
        asked = asked.unionByName(pairs)
        near, seen = confirmed(pairs, lean, docs, repeated)
        if seen["near"]:
            links = near if links is None else links.unionByName(near)
            found = cut(components(links))
        if GAIN * seen["near"] <= seen["n"]:
            break
        turn += 1
    for last in (False, True):
        placed = in_components(held, found)
        apart = placed.groupBy("member").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low <> high")
        held = cut(placed.join(apart.select("member"), "member", "left_semi"))
        other = held.select("member", F.col("row").alias("b"), F.col("least").alias("least_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"))
        pairs = held.join(other, "member").where((F.col("row") < F.col("b")) & (F.col("least") != F.col("least_b")) & reaches)
        held = held.drop("least")
        if not last:
            # of two large components a few pairs first, those that can share most; one that is similar settles the others
            most = (NUM + DEN) * F.least("rest", "rest_b") - NUM * (F.col("n") + F.col("n_b"))
            two = [F.least("least", "least_b").alias("one"), F.greatest("least", "least_b").alias("two"), F.pmod(F.xxhash64("row", "b"), F.lit(TRIES)).alias("turn")]
            pairs = pairs.groupBy(*two).agg(F.max(F.struct(most, "row", "b")).alias("best")).select("best.row", "best.b")
        pairs = cut(pairs.select(F.col("row").alias("a"), "b").distinct().join(asked, ["a", "b"], "left_anti"))
        asked = asked.unionByName(pairs)
        near, seen = confirmed(pairs, lean, docs, repeated)
        if seen["near"]:
            links = near if links is None else links.unionByName(near)
            found = cut(components(links))
    return found if found is not None else held.select(F.col("row").alias("node"), F.col("row").alias("least")).limit(0)


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each group of near copies, with all its columns."""
    marked = cut(described(docs))
    nodes = cut(marked.groupBy("whole").agg(F.min("row").alias("row")).select("row"))
    times = marked.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(times.where("n > 1").select("row"))
    found = similar(docs, marked, nodes, repeated)
    later = found.where("node <> least").select(F.col("node").alias("row"))
    stay = nodes.join(later, "row", "left_anti")
    drop = cut(times.join(stay, "row", "left_anti").select("row"))
    twice = cut(repeated.join(drop, "row", "left_anti"))
    (key,) = fresh(docs, "row")
    keyed = docs.withColumn(key, row_key(docs))
    left = keyed.join(drop.withColumnRenamed("row", key), key, "left_anti")
    if not twice.isEmpty():
        again = twice.withColumnRenamed("row", key)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
