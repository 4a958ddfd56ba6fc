import random

import xxhash
from pyspark.sql import functions as F

from footbridge.llm import simhash_bk as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """prints: {id: fingerprint} -> {id: least reachable}."""
    ids, comp = sorted(prints), {}
    for i in ids:
        if i in comp:
            continue
        comp[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in comp and (prints[a] ^ prints[b]).bit_count() <= radius:
                    comp[b] = i
                    todo.append(b)
    return comp


def test_fingerprints_and_groups(spark, docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 200]))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = word()
            texts.append(" \n".join(v).upper() if rng.random() < 0.5 else " ".join(v))
    texts += [None, "", " \t", "ÀB\x1cc d\xa0e", "x", "x", "long " * 30000]
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(None, "x", None, None), (3, texts[3], "en", "s")]
    got = S.group_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    assert len(set(want.values())) < len(want)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fp % 2**64 == slow_fingerprint("x")
        else:
            assert (r.fp % 2**64, r.component_id) == (prints[r.doc_id], want[r.doc_id])


def test_links_connect_like_brute_force(spark, monkeypatch):
    """Random fingerprints, chains at the radius and a dense cluster, with shards so small that they are cut."""
    monkeypatch.setattr(S, "SHARD", 40)
    monkeypatch.setattr(S, "VISITS", 500)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(100):
        prints.append(rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    base = rng.getrandbits(64)
    prints += [base ^ sum(1 << b for b in rng.sample(range(10, 30), rng.randint(0, 4))) for _ in range(400)]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    want = brute_components(dict(enumerate(prints)))
    for mean in (512, 1):
        monkeypatch.setattr(S, "MEAN_SHARD", mean)
        got = dict(enumerate(range(len(prints)))) | {r.node: r.least for r in S.components(S.links(nodes)).collect()}
        assert got == want


def test_long_chain_components(spark):
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(chain).collect()
    assert len(got) == 400 and {r.least for r in got} == {0}


def test_rows_that_share_an_id_link_nothing(spark, docs_of):
    """Texts A and B share an id; a near copy of A and a copy of B don't meet by that."""
    rng = random.Random(2)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(2))
    near = next(t for t in (a.replace(w, "changed") for w in a.split()) if 0 < (S.fingerprint(t) ^ S.fingerprint(a)).bit_count() <= 4)
    assert (S.fingerprint(a) ^ S.fingerprint(b)).bit_count() > 8
    rows = [(3, a), (3, b), (2, near), (5, b), (None, near), (None, "no id")]
    got = S.group_documents(docs_of([(i, t, "en", "s") for i, t in rows])).collect()
    prints = {S.fingerprint(t): t for _, t in rows}
    named = sorted(((r.doc_id, prints[r.fp % 2**64][:20], r.component_id) for r in got), key=str)
    assert named == sorted([(3, a[:20], 2), (3, b[:20], 3), (2, near[:20], 2), (5, b[:20], 3), (None, near[:20], None), (None, "no id", None)], key=str)
    assert S.group_documents(docs_of([])).collect() == []
