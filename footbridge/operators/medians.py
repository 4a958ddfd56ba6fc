"""Exact weighted medians by selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge.session import cut

FINER = 1000  # a level's buckets are this many times narrower than those of the level before


def weighted_medians(rows: DataFrame, keys: list[str], step: float, levels: int = 2) -> DataFrame:
    """``*keys, median, n`` of ``rows`` (``*keys, v, w``): the middle value, or the mean of both middle values.

    Weights are whole and positive; rows without a value have no say. Sums per bucket of width ``step`` tell which
    bucket holds the middle, and only its values are looked at again, in buckets ``FINER`` times narrower; after
    ``levels`` of that the distinct values of the last bucket are ordered. So a group is never gathered: a task
    orders at most (spread of a group / ``step``) sums, then ``FINER`` sums, then the distinct values within
    ``step / FINER ** (levels - 1)``.
    """
    cells = cut(rows.where("v is not null and w > 0").groupBy(*keys, "v").agg(F.sum("w").cast("long").alias("w")))
    total = cells.groupBy(*keys).agg(F.sum("w").alias("n"))
    # both middle places of an even count; one place twice if the count is odd
    asked = total.select(*keys, F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("place"), "n").distinct()
    part: list[str] = []
    left = cells
    for level in range(levels):
        width = step / FINER ** level
        b = f"b{level}"
        left = left.withColumn(b, F.floor(F.col("v") / width))
        here = [*keys, *part, b]
        order = Window.partitionBy(*keys, *part).orderBy(b)
        sums = left.groupBy(*here).agg(F.sum("w").alias("sum")).withColumn("end", F.sum("sum").over(order))
        met = asked.join(sums, [*keys, *part]).where("place < end and place >= end - sum")
        asked = cut(met.withColumn("place", F.expr("place - (end - sum)")).drop("sum", "end"))
        part.append(b)
        left = cut(left.join(asked.select(*here).distinct(), here, "left_semi"))
    order = Window.partitionBy(*keys, *part).orderBy("v")
    ends = left.withColumn("end", F.sum("w").over(order))
    found = asked.join(ends, [*keys, *part]).where("place < end and place >= end - w")
    return found.groupBy(*keys).agg(F.avg("v").alias("median"), F.first("n").alias("n"))
