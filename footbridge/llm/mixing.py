"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

The mix holds ``share`` times the size of the whole corpus. Sources get it in proportion to their weights, but no
source more than ``max_epochs`` times its own size; what a clamped source can't take is dealt to the others by weight
until none is above its cap. That level is found in one pass over the sources in the order in which they clamp: the
k-th clamps if the level left after the first k - 1 would lift it over its cap.

A source whose target is r times its size takes every document floor(r) times, and some once more: documents stand in a
seeded order, and are taken from its start until the rest of the target is met, so a source misses its target by half
a document at most. The cut is found by sums of hash buckets; only the documents of the bucket that holds the cut are
ordered, never a source's.

Defined results: a null text has size 0. The null source is a source; it comes last. Documents and sources of size 0
take nothing. A row's place comes from its doc_id and text, so rows without an id, and different texts of one id, have
places of their own. Rows that repeat both follow each other; only where the cut falls among them are they numbered, and
as many of them are taken as come nearest to the target (any of them, as they are alike). If all caps together are below
the share, every source is taken ``max_epochs`` times. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footbridge.llm.columns import fresh, pruned
from footbridge.llm.words import WORD
from footbridge.session import materialise

BUCKETS = 4096
SEED = 17
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's place in the seeded order: 60 bits that other engines compute alike."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def bucket_of(key: Column) -> Column:
    return F.shiftright(key, 60 - BUCKETS.bit_length() + 1).cast("int")


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with weights dealt in turn by code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1))


def fill_targets(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight); there are only as many rows as sources."""
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    laid = sources.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    laid = laid.withColumns({
        "budget": F.sum("source_size").over(everything) * share,
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(rest),
    })
    laid = laid.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    # the first source that stays under its cap sets the level for itself and all later ones; of equal ratios it has the highest level
    laid = laid.withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("minus")))).over(everything))
    target = F.when(F.col("final").isNull() | (F.col("ratio") < F.col("final.ratio")), F.col("cap"))
    target = target.otherwise(F.least(F.col("cap"), -F.col("final.minus") * F.col("weight")))
    return laid.select("source", "source_size", "weight", target.alias("target"))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a source: source, source_size, target, whole (repetitions of all), last (key up to which there is one more),
    part_key and part (where only some of a row's copies come once more: their key, and how many).

    ``sized`` has source, size and key."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    keyed = sized.select("source", "size", "key").withColumn("bucket", bucket_of(F.col("key")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("upto", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    both = sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    at = F.max(F.when(F.col("s.upto") < F.col("p.extra"), F.struct(F.col("s.bucket"), F.col("s.upto"))))
    cut = both.groupBy("p.source", "p.source_size", "p.target", "p.whole", "p.extra").agg(at.alias("at"))
    cut = materialise(cut.select("source", "source_size", "target", "whole", "extra", F.col("at.bucket").alias("bucket"), F.col("at.upto").alias("upto")))[0]
    same = F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.bucket") == F.col("c.bucket"))
    close = keyed.alias("k").join(cut.alias("c"), same).groupBy("c.source", "c.extra", "c.upto", "k.key").agg(
        F.sum("k.size").alias("n"), F.count(F.lit(1)).alias("copies"), F.max("k.size").alias("size"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    close = close.withColumn("ahead", F.col("upto") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # a row that would overshoot is taken if that comes nearer to the target
    fits = F.when(F.col("size") > 0, F.floor((F.col("extra") - F.col("ahead")) / F.col("size") + 0.5)).otherwise(F.when(
        F.col("ahead") <= F.col("extra"), F.col("copies")).otherwise(F.lit(0)))
    close = close.withColumn("fits", F.least(fits, F.col("copies")))
    last = close.groupBy("source").agg(
        F.max(F.when(F.col("fits") == F.col("copies"), F.col("key"))).alias("last"),
        F.min(F.when((F.col("fits") > 0) & (F.col("fits") < F.col("copies")), F.struct("key", "fits"))).alias("p"))
    start = F.shiftleft(F.coalesce("c.bucket", F.lit(0)).cast("long"), 60 - BUCKETS.bit_length() + 1) - 1
    full = cut.alias("c").join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")), "left")
    # written, so that Spark knows its true size before it plans the join with the documents
    return materialise(full.select("c.source", "c.source_size", "c.target", "c.whole", F.coalesce("l.last", start).alias("last"),
                                   F.col("l.p.key").alias("part_key"), F.col("l.p.fits").alias("part")))[0]


def times(rows: DataFrame, cut: DataFrame, key: Column) -> tuple[DataFrame, str, str]:
    """``rows`` of sources in ``cuts``, with two new columns, named in turn: how often the mix takes each, and its source's size and target.

    Rows are numbered only where the cut parts copies of one row."""
    n, part, of = fresh(rows, "times", "part", "of")
    known = rows.alias("d").join(cut.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    known = known.select("d.*", F.struct("c.source_size", "c.target").alias(of), (F.col("c.whole") + (key <= F.col("c.last")).cast("long")).alias(n),
                         F.when(key == F.col("c.part_key"), F.col("c.part")).alias(part))
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    shared = known.where(F.col(part).isNotNull()).withColumn(n, F.col(n) + (place <= F.col(part)).cast("long"))
    return known.where(F.col(part).isNull()).unionByName(shared).drop(part), n, of


def planned(sized: DataFrame, weights: DataFrame | None, share: float, max_epochs: float) -> DataFrame:
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = repeating_weights(sources)
    else:
        same = F.col("a.source").eqNullSafe(F.col("b.source"))
        sources = sources.alias("a").join(weights.alias("b"), same).select("a.source", "a.source_size", F.col("b.weight").cast("double").alias("weight"))
    return cuts(sized, fill_targets(sources, share, max_epochs))


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    key = order_key(F.col("doc_id"), F.col("text"), seed).alias("key")
    return materialise(pruned(docs, "doc_id", "source", "text").select("doc_id", "source", size_of(F.col("text")).alias("size"), key))[0]


def epochs(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and ``times``, how often the mix takes the document, for every document.

    ``weights`` has (source, weight), without them 3, 1, 2 repeat over the sources in order. Sources without a weight
    are left out."""
    sized = sizes(docs, seed)
    known, n, of = times(sized, planned(sized, weights, share, max_epochs), F.col("d.key"))
    return known.select("doc_id", "source", "size", f"{of}.source_size", f"{of}.target", F.col(n).alias("times"))


def take(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: ``docs``' columns, each document as often as it is taken. Texts aren't shuffled."""
    cut = planned(sizes(docs, seed), weights, share, max_epochs)
    known, n, _ = times(docs, cut, order_key(F.col("d.doc_id"), F.col("d.text"), seed))
    [copy] = fresh(known, "copy")
    once = known.where(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int"))).alias(copy))
    return once.drop(copy)
