import random

import pytest

from footbridge.operators import search


def slow(term, keys, n):
    """Best ``n`` of (idx, is_main, key) by looking at every key."""
    q = term.strip()
    best = {}
    for idx, is_main, key in keys:
        if q in key:
            o = (not key.startswith(q), not is_main, key, idx)
            best[idx] = min(best.get(idx, o), o)
    return [o[3] for o in sorted(best.values())[:n]]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_every_kind_of_term_like_a_scan(spark, n):
    rng = random.Random(n)
    name = lambda: "".join(rng.choice("aaabbc") for _ in range(rng.randrange(1, 9)))
    stations = [(i, name(), name() if i % 3 else "", i % 7 == 0) for i in range(400)] + [(1000 + i, "aab" + "c" * (i % 4), "ca", False) for i in range(60)]
    keys = search.search_keys(spark.createDataFrame(stations, "idx long, name string, alias string, is_main boolean")).cache()
    plain = [(r.idx, r.is_main, r.key) for r in keys.collect()]
    terms = {"a", "b", "c", "d", "ab", "cc", "ca", "abc", "ccc", "bca", "aaab", "ccab", "xyz", "abcabc", *[s[1] for s in stations[:60]]}
    got = {}
    for r in search.search_stations(spark.createDataFrame([(t,) for t in terms], "term string"), keys, n).collect():
        got.setdefault(r.term, {})[r["rank"]] = r.idx
    assert {t: [at[k] for k in sorted(at)] for t, at in got.items()} == {t: x for t in terms if (x := slow(t, plain, n))}


def test_a_node_holds_no_more_than_asked(spark):
    rows = [(i, f"stop {i:05d}", "", False) for i in range(3000)]
    keys = search.search_keys(spark.createDataFrame(rows, "idx long, name string, alias string, is_main boolean"))
    sizes = search.name_trie(keys, 4).groupBy("node").count()
    assert sizes.agg({"count": "max"}).first()[0] == 4
    assert [r.idx for r in search.name_trie(keys, 4).where("node = 's'").orderBy("key").collect()] == [0, 1, 2, 3]
