"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

A document's statistics, standardised over the learning rows, pass through seeded random Fourier features, whose inner
products approximate a Gaussian kernel. Each partition sums its normal equations; the sums of two folds give a model of
each fold for the other, and one of both. Scores of learning rows by the model that hasn't seen them are counted in
narrow bins, and pooling adjacent violators over the bins gives a rising map from score to probability.

Learning reads a bounded sample of labelled rows (``LEARN``, by a hash range); scoring reads every document.

Defined results: a null text counts as empty; every document gets a score from 0 to 1. Repeated rows are scored each.
Labels that are null teach nothing; without any label every score is 0.5. An empty table gives an empty result. Further
columns, and the language, source and id, have no part in a score.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned
from footbridge.llm.words import SYMBOLS, covered_words, repeated_lines, words_of
from footbridge.session import materialise

FEATURES = ["size", "word_length", "symbols", "lines", "repeats", "capitals", "digits", "variety", "line_size", "marks", "top_word", "long_words"]
WAVES = 256
SEED = 11
RIDGE = 3.0
LEARN = 200_000  # labelled rows that learning reads, on average
TASKS = 16  # partitions whose sums come to the driver; the sums have a fixed size
BINS = 500  # of the score range that calibration counts, per unit
_CAPITAL, _DIGIT, _MARK = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[0-9]"), re.compile("[!?;:]")


def statistics(text: str | None) -> tuple[float, ...]:
    """The values named in ``FEATURES``."""
    words = words_of(text)
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = sum(map(len, words))
    lines, again = repeated_lines(text)
    times = Counter(words)
    return (
        np.log1p(n), chars / n, sum(map(text.count, SYMBOLS)) / chars, again / lines, covered_words(words, 3) / n, len(_CAPITAL.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars, len(times) / n, np.log1p(n / lines), len(_MARK.findall(text)) / chars, max(times.values()) / n, sum(len(w) > 12 for w in words) / n,
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document, as columns."""

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=FEATURES, dtype="float64")

    return pruned(docs, "doc_id", "text").select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


class Waves:
    """Standardised statistics to random Fourier features, with a constant first."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, waves: int = WAVES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.normal(0.0, 1.0 / np.sqrt(len(mean)), (len(mean), waves))
        self.shift = rng.uniform(0, 2 * np.pi, waves)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)], axis=1)


def normal_sums(rows: DataFrame, waves: Waves) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of two folds the summed z z' and z y over rows of statistics, label and fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(waves.shift) + 1
        a, b = np.zeros((2, size, size)), np.zeros((2, size))
        for batch in batches:
            z, y, fold = waves(batch[FEATURES].to_numpy()), batch["label"].to_numpy(), batch["fold"].to_numpy()
            for f in (0, 1):
                a[f] += z[fold == f].T @ z[fold == f]
                b[f] += z[fold == f].T @ y[fold == f]
        yield pd.DataFrame({"sums": [pickle.dumps((a, b))]})

    parts = [pickle.loads(r.sums) for r in rows.repartition(TASKS).mapInPandas(run, "sums binary").collect()]
    size = len(waves.shift) + 1
    return [(sum((a[f] for a, _ in parts), np.zeros((size, size))), sum((b[f] for _, b in parts), np.zeros(size))) for f in (0, 1)]


def ridge(a: np.ndarray, b: np.ndarray, strength: float = RIDGE) -> np.ndarray:
    """Weights; the constant isn't shrunk."""
    shrink = strength * np.eye(len(b))
    shrink[0, 0] = 1e-9
    return np.linalg.solve(a + shrink, b)


def pooled(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (x, share) of the rising fit to sums y of n rows at x, in order of x."""
    blocks: list[list[float]] = []
    for at, count, hits in zip(x, n, y, strict=True):
        blocks.append([at * count, count, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


class Model:
    def __init__(self, waves: Waves, weights: np.ndarray, points: tuple[np.ndarray, np.ndarray]):
        self.waves, self.weights, self.points = waves, weights, points

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.waves(x) @ self.weights, *self.points), 0, 1)


def learn(known: DataFrame, most: int = LEARN) -> Model | None:
    """Fit to rows (doc_id, statistics, label 0 or 1)."""
    n = known.count()
    part = known if n <= most else known.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    part = materialise(part.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")))[0]
    moments = part.select(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    if moments[0] is None:
        return None
    waves = Waves(np.array([moments[f"m_{f}"] for f in FEATURES]), np.array([moments[f"s_{f}"] for f in FEATURES]))
    (a0, b0), (a1, b1) = normal_sums(part, waves)
    other = [ridge(a1, b1), ridge(a0, b0)]  # for each fold the weights that the other one gives

    @F.pandas_udf("double")
    def unseen(fold: pd.Series, *columns: pd.Series) -> pd.Series:
        z = waves(np.stack([c.to_numpy() for c in columns], axis=1))
        return pd.Series(np.where(fold.to_numpy() == 0, z @ other[0], z @ other[1]))

    at = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), unseen("fold", *FEATURES))) * BINS).cast("int")
    bins = part.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("at").collect()  # 3 * BINS rows at most
    points = pooled(np.array([r.at / BINS for r in bins]), np.array([float(r.n) for r in bins]), np.array([float(r.y) for r in bins]))
    return Model(waves, ridge(a0 + a1, b0 + b1), points)


def score(rows: DataFrame, model: Model | None) -> Column:
    """The probability of label 1 from the columns of statistics."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model(np.stack([c.to_numpy() for c in columns], axis=1)))

    return run(*FEATURES)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; labels (doc_id, quality) of held-out ids teach nothing."""
    rows = materialise(described(docs))[0]
    taught = pruned(labels, "doc_id", "quality").where("quality is not null").where(~held_out(F.col("doc_id")))
    known = rows.join(taught.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(rows, learn(known)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
