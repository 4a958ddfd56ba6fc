"""Quality rules with adaptive thresholds.

Every document is measured once. Each measure goes into a quantile sketch per language and source: counts of
logarithmic buckets, whose relative error is bounded and which merge by adding counts. Merged sketches of a language,
and of all documents, stand in for groups too small to trust. Limits are made of the quartiles of a group's sketch. Symbol
rates and word lengths may exceed the upper quartile by a multiple of the distance between the quartiles. Repeated
lines and words are absent from most texts, so their limits come from the part of the sketch above zero: its median, raised by a power
of the ratio between median and lower quartile. Documents that the base rules reject are not in the sketches. Thresholds are then joined to the measures.

Defined results: a null text counts as empty; empty texts have no words and fail the base rules. Null languages and
sources are groups of their own. Repeated rows are each judged and each count. An empty table gives an empty result.
Further columns are kept by ``keep_good`` and ignored elsewhere.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footbridge.llm.columns import fresh, pruned
from footbridge.llm.words import SYMBOLS, covered_words, repeated_lines, words_of
from footbridge.session import cut, materialise

GAMMA = 1.02  # bucket i holds values in (GAMMA ** (i - 1), GAMMA ** i]; bucket 0 holds zero
MIN_GROUP = 100  # documents a group needs for thresholds of its own
# measures are in thousandths: (multiple of the distance between quartiles, least distance), (power of the ratio, least ratio)
SPREADS = {"symbol_rate": (4, 10.0), "word_length": (8, 100.0)}
RATIOS = {"line_rate": (3, 1.5), "repeat_rate": (5, 1.5)}
LIMITS = ["symbol_rate", "line_rate", "repeat_rate", "word_length"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def count_text(text: str | None) -> tuple[int, ...]:
    """The values named in ``COUNTS``."""
    words = words_of(text)
    if not words:
        return (0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, 0)
    n_lines, n_dup = repeated_lines(text)
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_lines, n_dup, covered_words(words, 3))


def text_counts(text: Column) -> Column:
    """The struct of counts."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS, dtype="int64")

    return run(text)


def rates(c: Column) -> dict[str, Column]:
    """The measures, whole thousandths, of a struct of counts."""

    def per_mille(part: str, whole: str) -> Column:
        return F.when(c[whole] > 0, F.floor(c[part] * 1000 / c[whole])).otherwise(F.lit(0)).cast("long")

    return {
        "symbol_rate": per_mille("n_symbols", "word_chars"),
        "line_rate": per_mille("n_dup_lines", "n_lines"),
        "repeat_rate": per_mille("n_repeat_words", "n_words"),
        "word_length": per_mille("word_chars", "n_words"),
    }


def base_failed(c: Column) -> Column:
    return (c.n_words < 50) | (c.n_repeat_words * 100 > c.n_words * 50)


def bucket_of(v: Column) -> Column:
    return F.when(v <= 0, F.lit(0)).otherwise(F.lit(1) + F.ceil(F.log(v.cast("double")) / math.log(GAMMA))).cast("int")


def value_of(bucket: Column) -> Column:
    """The middle of a bucket, within 1 % of any value in it."""
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), bucket - 1) * (2 / (1 + GAMMA)))


def sketches(counted: DataFrame) -> DataFrame:
    """Bucket counts of each (lang, source, measure); ``counted`` has lang, source and the struct counts."""
    measures = F.array(*[F.struct(F.lit(k).alias("measure"), bucket_of(v).alias("bucket")) for k, v in rates(F.col("counts")).items()])
    return (
        counted.select("lang", "source", F.explode(measures).alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets are added."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """One row a group of ``keys`` and measure: how many documents speak for it, and the highest value it may have."""
    told = sketch.where(~F.col("measure").isin(*RATIOS) | (F.col("bucket") > 0))
    group = Window.partitionBy(*keys, "measure")
    ranked = told.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "size": F.sum("n").over(group)})

    def quantile(q: float) -> Column:
        return value_of(F.min(F.when(F.col("upto") >= F.col("size") * q, F.col("bucket"))))

    parts = ranked.groupBy(*keys, "measure", "size").agg(quantile(0.25).alias("low"), quantile(0.5).alias("mid"), quantile(0.75).alias("high"))
    limit = F.lit(None).cast("double")
    for k, (times, least) in SPREADS.items():
        limit = F.when(F.col("measure") == k, F.col("high") + times * F.greatest(F.col("high") - F.col("low"), F.lit(least))).otherwise(limit)
    for k, (power, least) in RATIOS.items():
        limit = F.when(F.col("measure") == k, F.col("mid") * F.pow(F.greatest(F.try_divide("mid", "low"), F.lit(least)), F.lit(power))).otherwise(limit)
    return parts.select(*keys, "measure", "size", limit.alias("limit"))


def thresholds(counted: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) with a limit for each measure, from the finest group in which at least ``min_group`` documents speak for
    it, else from all documents; null where nothing does."""
    sketch = materialise(sketches(counted.where(~base_failed(F.col("counts")))))[0]
    groups = sketch.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, LIMITS))).alias("measure"))
    levels = [
        (fences(sketch, "lang", "source").where(F.col("size") >= min_group), ("lang", "source")),
        (fences(merged(sketch, "lang"), "lang").where(F.col("size") >= min_group), ("lang",)),
        (fences(merged(sketch)), ()),
    ]
    for i, (limits, keys) in enumerate(levels):
        same = F.col("g.measure") == F.col("f.measure")
        for k in keys:
            same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}"))
        groups = groups.alias("g").join(limits.alias("f"), same, "left").select("g.*", F.col("f.limit").alias(f"limit{i}"))
    best = F.coalesce(*[f"limit{i}" for i in range(len(levels))])
    per = [F.max(F.when(F.col("measure") == k, best)).alias(f"max_{k}") for k in LIMITS]
    # written, so that Spark knows its true size before it plans the join with the documents
    return materialise(groups.groupBy("lang", "source").agg(*per))[0]


def within(counts: Column) -> Column:
    """True if no measure exceeds its joined limit."""
    ok = F.lit(True)
    for k, v in rates(counts).items():
        ok = ok & (v <= F.coalesce(F.col(f"t.max_{k}"), F.lit(float("inf"))))
    return ok


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the struct counts of every document."""
    return pruned(docs, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", text_counts(F.col("text")).alias("counts"))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept."""
    same = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    counts = F.col("d.counts")
    failed = base_failed(counts)
    return counted.alias("d").join(limits.alias("t"), same, "left").select("d.*", failed.alias("base_failed"), (~failed & within(counts)).alias("kept"))


def apply_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""
    counted = materialise(measured(docs))[0]
    return judge(counted, thresholds(counted, min_group)).select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in COUNTS], "base_failed", "kept")


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that pass, with all their columns. Each is measured once and written with its counts; texts aren't
    shuffled, as the limits are small and come to them."""
    (counts,) = fresh(docs, "counts")
    counted = cut(docs.withColumn(counts, text_counts(docs["text"])))
    limits = thresholds(counted.select("lang", "source", F.col(counts).alias("counts")), min_group)
    c = F.col(f"d.{counts}")
    same = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    judged = counted.alias("d").join(limits.alias("t"), same, "left").where(~base_failed(c) & within(c))
    return judged.select(*[F.col(f"d.`{x}`") for x in docs.columns])
