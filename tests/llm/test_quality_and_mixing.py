import math
import os
import random
from collections import Counter

import duckdb
import pytest

from footbridge.llm import mixing, quality_rules
from footbridge.llm.sql import MIXING, QUALITY_RULES
from pyspark.sql import functions as F

EDGES = [
    (0, None, None, None), (1, "", "en", "b"), (2, " \n\t", "en", "b"), (3, "a b c a b c a b c", "en", "b"), (4, "x\ny\nx\n\n", None, "a"), (5, "w " * 40000, "de", None),
    (6, "é😀 # $ % <b>", "en", "a"), (6, "é😀 # $ % <b>", "en", "a"), (None, "no id", "en", "a"), (8, "one two three four " * 20, "en", "b"),
]


def check(docs, spark_rows, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else -1 if v is None else v
    want = sorted(tuple(map(norm, r)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in spark_rows) == want
    return want


def test_rules_on_edges(docs_of):
    docs = docs_of(EDGES)
    assert len(check(docs, quality_rules.apply_rules(docs).collect(), QUALITY_RULES)) == len(EDGES)
    empty = docs_of([])
    assert quality_rules.apply_rules(empty).collect() == [] and quality_rules.keep_good(empty).collect() == []


def test_kept_documents_keep_their_columns(spark, docs_of):
    good = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(80)), "en", "s") for i in range(150)]
    bad = [(1000 + i, " ".join(f"word{(i + j * j) % 997}###" for j in range(80)), "en", "s") for i in range(30)]
    docs = docs_of(good + bad + EDGES)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(150))


def test_rules_part_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    n = Counter((r.quality, r.kept) for r in quality_rules.apply_rules(docs).where("n_words >= 50").join(labels, "doc_id").collect())
    assert n[1, True] >= 0.98 * (n[1, True] + n[1, False]) and n[0, False] >= 0.9 * (n[0, True] + n[0, False])


def test_limits_follow_their_groups(spark, docs_of):
    """Texts of one source repeat words and use symbols several times as often as those of another one; each gets its own limits."""
    rng = random.Random(5)

    def text(repeats, symbols):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(rng.choice([0, 0, 0, repeats, repeats, 2 * repeats])):
            words += words[10:13]
        return " ".join(words + ["#" * 9] * (rng.choice([2, 3, 4]) * symbols))

    rows = [(i, text(1, 0), "en", "prose") for i in range(300)] + [(1000 + i, text(6, 6), "en", "code") for i in range(300)]
    rows += [(2000, text(1, 6), "en", "prose"), (2001, text(1, 6), "en", "code")]
    docs = docs_of(rows)
    counted = quality_rules.measured(docs)
    prose, code = (quality_rules.thresholds(counted).where(F.col("source") == s).first() for s in ("prose", "code"))
    assert code.max_symbol_rate >= 3 * prose.max_symbol_rate and code.max_repeat_rate >= 3 * prose.max_repeat_rate
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()}
    assert not got[2000] and got[2001] and sum(got.values()) >= 0.98 * len(rows)
    check(docs, quality_rules.apply_rules(docs).collect(), QUALITY_RULES)


def test_mix_on_edges(docs_of):
    docs = docs_of(EDGES)
    times = mixing.epochs(docs).selectExpr("doc_id", "size", "source_size", "target", "times * size taken")
    assert len(check(docs, times.collect(), MIXING)) == len(EDGES)
    assert mixing.epochs(docs_of([])).collect() == [] and mixing.take(docs_of([])).collect() == []


def water(sizes, weights, share, cap):
    """Targets by redealing the excess until none is above its cap."""
    out, left, open_ = {}, share * sum(sizes.values()), dict(weights)
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total >= cap * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
        left = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("share", [0.5, 1.5, 1.99, 2.0])
def test_targets_and_shares(docs_of, share):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", f"s{int(math.sqrt(i)) % 9}" if i % 11 else None) for i in range(900)]
    docs = docs_of(rows)
    got = mixing.epochs(docs, share=share).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = water(sizes, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, share, 2.0)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.times <= 2
        taken[r.source] += r.times * r.size
    assert all(abs(taken[s] - want[s]) <= 45 for s in sizes)
    copies = Counter(r.doc_id for r in mixing.take(docs, share=share).collect())
    assert copies == Counter({r.doc_id: r.times for r in got if r.times})


def test_rows_without_id_and_copies_meet_the_target(docs_of):
    words = "one two three four five six seven eight nine ten"
    rows = (
        [(None, f"{words} {i}", "en", "a") for i in range(100)]      # no ids, different texts
        + [(None, words, "en", "b") for _ in range(100)]             # no ids, one text
        + [(7, f"{words} {i % 4}", "en", "c") for i in range(100)]   # one id, four texts
        + [(i, f"{words} {i}", "en", "d") for i in range(1000, 1100)]
    )
    docs = docs_of(rows)
    for share in (0.83, 1.37):
        got = mixing.epochs(docs, share=share).collect()
        taken, size = Counter(), {r.source: r.size for r in got}
        for r in got:
            taken[r.source] += r.times * r.size
            assert 0 <= r.times <= 2
        order = sorted(size)
        source_size = {r.source: r.source_size for r in got}
        want = water(source_size, {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}, share, 2.0)
        assert all(r.target == pytest.approx(want[r.source]) for r in got)  # a and d clamp at the same level
        assert all(abs(taken[r.source] - r.target) <= size[r.source] / 2 + 1e-6 for r in got) and len(got) == len(rows)
        mix = Counter(r.source for r in mixing.take(docs, share=share).collect())
        assert {s: n * size[s] for s, n in mix.items()} == dict(taken)
    check(docs, mixing.epochs(docs).selectExpr("doc_id", "size", "source_size", "target", "times * size taken").collect(), MIXING)


def test_sql_at_small_scale(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, mixing.epochs(docs).selectExpr("doc_id", "size", "source_size", "target", "times * size taken").collect(), MIXING)
    check(docs, quality_rules.apply_rules(docs).collect(), QUALITY_RULES)
    assert os.path.isdir(sf)
