"""Medians by selection against sorted lists."""

import random

from footbridge.operators.medians import weighted_medians


def middle(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_medians_of_wide_narrow_and_repeated_values(spark):
    rnd = random.Random(5)
    groups = {
        "wide": [(47 + rnd.random() / 100, rnd.randint(1, 4)) for _ in range(999)],
        "narrow": [(47 + rnd.random() * 1e-7, 1) for _ in range(500)],
        "below zero": [(-8.5 + rnd.random() / 50, 2) for _ in range(300)],
        "one place": [(9.25, 3), (9.25, 4)],
        "two": [(1.0, 1), (2.0, 1)],
        "heavy end": [(1.0, 1), (2.0, 1), (3.0, 10)],
        "single": [(5.5, 1)],
    }
    rows = [(k, v, w) for k, vs in groups.items() for v, w in vs] + [("wide", None, 7), ("empty", None, 1)]
    got = {r.k: (r.median, r.n) for r in weighted_medians(
        spark.createDataFrame(rows, "k string, v double, w int"), ["k"], 1e-5).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert abs(got[k][0] - middle([v for v, w in vs for _ in range(w)])) < 1e-12 and got[k][1] == sum(w for _, w in vs)


def test_crowded_track_and_empty_table(spark):
    rows = spark.range(200_000).selectExpr("'t' as k", "47 + pmod(id * 7919, 200000) * 5e-8 as v", "1 as w").repartition(8)
    [r] = weighted_medians(rows, ["k"], 1e-5).collect()
    assert abs(r["median"] - (47 + (99_999 + 100_000) / 2 * 5e-8)) < 1e-11 and r.n == 200_000
    assert weighted_medians(rows.limit(0), ["k"], 1e-5).count() == 0
