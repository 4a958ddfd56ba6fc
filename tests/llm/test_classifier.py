import zlib

import numpy as np
import pytest

from footbridge.llm import rff_quality as R


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return R.classify(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.7)).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    test = scored[scored.held_out & scored.quality.notna()]
    good, bad = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    auc = ((good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2)
    assert len(test) > 800 and auc >= 0.97 and (test.predicted == test.quality).mean() >= 0.97


def test_scores_are_calibrated(scored):
    test = scored[scored.held_out & scored.quality.notna()]
    assert abs(test.score.mean() - test.quality.mean()) <= 0.02


def test_waves_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12)) * 0.7
    waves = R.Waves(np.zeros(12), np.ones(12), waves=20000)
    z = waves(x)[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 24)
    assert np.abs(z @ z.T - want).max() < 0.05


def test_pooling_is_the_rising_fit():
    x, n, y = np.arange(6.0), np.array([1.0, 2, 1, 4, 1, 1]), np.array([1.0, 0, 1, 2, 1, 0])
    _, value = R.pooled(x, n, y)
    assert value.tolist() == pytest.approx([1 / 3, 4 / 7])


def test_edges(spark, docs_of):
    rows = [(i, ("good words stand here " if i % 2 else "#### ") * (i + 1), "en", "s") for i in range(40)] + [(50, None, None, None), (50, "", "en", "s"), (None, "x " * 50000, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(50, None, "x"), (None, 1, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    got = R.classify(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in R.classify(docs_of(rows), labels.limit(0)).collect()} == {0.5}
    assert R.classify(docs_of([]), labels).collect() == []
