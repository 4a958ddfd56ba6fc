"""Fill-in-middle transformation with an indexable skip list.

A text's units are its lines, ends included. The list's towers have heights from a fixed random sequence; every link of
a lane knows how many units it passes and how many code points these hold. A cut after so many units is found from the
top lane down: a link is followed while its unit width fits into what is left, and the code-point widths of the links
followed add up to the place of the cut. Building is linear: a tower closes the open links of its lanes, each of which
then counts as one step of the lane above.

Texts stay in the JVM; Python workers get them once and give back three numbers a text. Where to cut, and how to arrange
the parts, depends on the seed and doc_id alone.

Defined results: a null text counts as empty and is plain; so is a text that holds a mark. A null doc_id hashes like an
empty one. Repeated rows get the same cuts. Texts of any length are cut whole. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned

SEED = 7
RATE = 100  # texts of a hundred that are transformed
SPM = 50  # of a hundred transformed texts, those with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LANES = 16  # towers of all lanes are one in 4 ** 15
_draw = random.Random(1).random
HEIGHTS = [next((h for h in range(1, LANES) if _draw() >= 0.25), LANES) for _ in range(8191)]


class SkipList:
    """Units in order, each of some code points."""

    def __init__(self, widths: Iterable[int]):
        # of every link of each lane: units passed, their code points, and where the lane below goes on
        self.units: list[list[int]] = [[] for _ in range(LANES)]
        self.points: list[list[int]] = [[] for _ in range(LANES)]
        self.below: list[list[int]] = [[] for _ in range(LANES)]
        units, points, below = self.units, self.points, self.below
        open_units, open_points = [0] * (LANES + 1), [0] * (LANES + 1)
        n = 0
        for width in widths:
            u, p = 1, width
            height = HEIGHTS[n % len(HEIGHTS)]
            n += 1
            for lane in range(height):
                u += open_units[lane]
                p += open_points[lane]
                open_units[lane] = open_points[lane] = 0
                units[lane].append(u)
                points[lane].append(p)
                if lane:
                    below[lane].append(len(units[lane - 1]))
            open_units[height] += u
            open_points[height] += p
        self.size = n

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        at, passed = 0, 0
        for lane in range(LANES - 1, -1, -1):
            units, points = self.units[lane], self.points[lane]
            while at < len(units) and units[at] <= rank:
                rank -= units[at]
                passed += points[at]
                at += 1
            if lane:
                at = self.below[lane][at - 1] if at else 0
        return passed


def widths(text: str) -> list[int]:
    """Code points of each line, its end included."""
    parts = text.split("\n")
    last = len(parts.pop())
    return [len(p) + 1 for p in parts] + [last] * (last > 0)


def cuts(text: str | None, a: int, b: int) -> tuple[int, int, int]:
    """How many units there are, and the code points before the first cut and between the two."""
    units = SkipList(widths(text or ""))
    low, high = sorted((a % (units.size + 1), b % (units.size + 1)))
    before = units.points_before(low)
    return units.size, before, units.points_before(high) - before


def draw(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th number, from 1, that the seed gives a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def text_cuts(text: Column, a: Column, b: Column) -> Column:
    """The struct of what ``cuts`` returns."""

    @F.pandas_udf("n long, prefix_chars long, middle_chars long")
    def run(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [cuts(*row) for row in zip(texts, a, b, strict=True)]
        return pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, 3), columns=["n", "prefix_chars", "middle_chars"])

    return run(text, a, b)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every document."""
    slim = pruned(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = [draw(F.col("doc_id"), seed, i) for i in range(1, 5)]
    plain = (F.col("text") == "") | F.col("text").rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (h[2] % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(h[3] % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    cut = slim.select("doc_id", "text", form.alias("form"), text_cuts(F.col("text"), h[0], h[1]).alias("c"))
    text, p, m = F.col("text"), F.col("c.prefix_chars"), F.col("c.middle_chars")
    part = {PREFIX: F.substr(text, F.lit(1), p), MIDDLE: F.substr(text, p + 1, m), SUFFIX: F.substr(text, p + m + 1)}
    in_order = lambda *marks: F.concat(*[x for mark in marks for x in (F.lit(mark), part[mark])])
    is_plain = F.col("form") == "plain"
    output = F.when(is_plain, text).when(F.col("form") == "psm", in_order(PREFIX, SUFFIX, MIDDLE)).otherwise(in_order(SUFFIX, PREFIX, MIDDLE))
    chars = [F.when(~is_plain, x).alias(k) for k, x in (("prefix_chars", p), ("middle_chars", m))]
    return cut.select("doc_id", F.col("c.n").alias("n"), "form", *chars, output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that was transformed. A transformed text holds each mark once."""
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    middle = after(output, MIDDLE)
    head = upto(output, MIDDLE)
    psm = F.concat(after(upto(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(upto(head, PREFIX), SUFFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
