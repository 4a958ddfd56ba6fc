import random
from itertools import combinations

import pytest

import corpus_pipeline as P
from footbridge.llm import near_copies as N


def slow_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(texts):
    """{id: text} -> ids that are the least of their component."""
    sets, least = {i: slow_set(t) for i, t in texts.items()}, {i: i for i in texts}
    near = [(a, b) for a, b in combinations(texts, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return {i for i, j in least.items() if i == j}


@pytest.mark.parametrize("common", [0, 65536])
def test_stage_finds_every_similar_pair(spark, docs_of, monkeypatch, common):
    monkeypatch.setattr(N, "MOST_COMMON", common)
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = some(40), [None, "", " \t", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for n in (8, 60, 200):
        for _ in range(8):
            base = some(n)
            texts.append(" ".join(base))
            for changes in (1, 2, 4, 7):
                w = list(base)
                for _ in range(changes):
                    w[rng.randrange(n)] = "changed"
                texts.append(" ".join(w).upper())
    texts += [" ".join(some(60) + passage) for _ in range(12)] + [" ".join(passage + some(k)) for k in range(12)]
    rng.shuffle(texts)
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    want = slow_kept(dict(enumerate(texts)))
    assert len(want) < len(texts) - 40
    got = dict(P.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    assert dict(P.STAGES)["simhash_near_dedup"](spark, docs.limit(0), "").collect() == []


def test_rows_that_share_an_id(spark, docs_of):
    """Each row is judged by its own text: an id's other rows don't go with one of them, and rows without id count too."""
    copy, other, third = "a b c d e f g", "other words stand in here", "a third text of some words"
    rows = [(1, copy, "en", "s"), (2, copy, "en", "s"), (2, other, "en", "s"), (3, third, "en", "s"), (3, third, "en", "s"), (None, copy, "en", "s"), (None, "no id", "en", "s"), (None, "no  ID", "en", "s")]
    got = [(r.doc_id, " ".join(r.text.lower().split())) for r in N.keep_first(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, copy), (2, other), (3, third), (None, "no id")], key=str)


def test_common_shingles_of_a_table_much_larger_than_the_sample(spark, docs_of, monkeypatch):
    """A passage in one text of sixteen is common however many texts there are to a text of the least sample."""
    monkeypatch.setattr(N, "SAMPLE", 16)
    passage = " ".join(f"p{i}" for i in range(9))
    texts = [f"t{i} " + (passage if i % 16 == 0 else "alone") for i in range(1600)]
    common = N.common_shingles(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])).tolist()
    assert set(N.shingles(passage).tolist()) <= set(common)


def test_texts_that_share_a_passage_are_not_all_confirmed(spark, docs_of, monkeypatch):
    """No pair is confirmed twice, and texts that share a passage of half their words late in the order meet no other."""
    asked, judge = [], N.confirmed

    def watched(pairs, *args):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return judge(pairs, *args)

    monkeypatch.setattr(N, "confirmed", watched)
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = some(40), some(200)
    texts = [" ".join(some(40) + passage) for _ in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = some(1)[0]
        texts.append(" ".join(w))
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    kept = {r.doc_id for r in N.keep_first(docs).collect()}
    assert kept == slow_kept(dict(enumerate(texts)))
    assert len(asked) == len(set(asked)) and not [p for p in asked if p[0] > p[1]]
    assert not [p for p in asked if p[0].id < 60 and p[1].id < 60]
