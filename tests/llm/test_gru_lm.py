import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from footbridge.llm import gru_lm as G
from footbridge.llm.queries import op13


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base(rows):
    """held_out, n_tokens, n_known, train_tokens and base_score of each row."""
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def a_model(words=11, hidden=5, classes=3, seed=3):
    model = G.untrained(np.arange(words, 0, -1), 7, hidden, classes, seed)
    rng = np.random.default_rng(seed)
    real = model.weights > -50
    model.weights[real] += rng.normal(0, 0.3, real.sum()).astype(np.float32)
    return model


def slow_logs(model, doc):
    """Natural log probability of each token of one document, a token at a time in double precision."""
    x, u, wc, wm = (getattr(model, k).astype(np.float64) for k in ("x", "u", "wc", "wm"))
    h, before, out, s = np.zeros(model.hidden), model.start, [], model.hidden
    for token in doc:
        z, r = (1 / (1 + np.exp(-(x[before, k * s : (k + 1) * s] + u[k * s : (k + 1) * s] @ h))) for k in (0, 1))
        h = (1 - z) * h + z * np.tanh(x[before, 2 * s :] + r * (u[2 * s :] @ h))
        k, m = divmod(token, model.members)
        p, q = np.exp(wc @ [*h, 1]), np.exp(wm[k] @ [*h, 1]) if k < model.classes else np.ones(1)
        out.append(np.log(p[k] / p.sum()) + np.log(q[m] / q.sum()))
        before = token
    return out


def some_docs(seed, n=40, words=11):
    rng = np.random.default_rng(seed)
    ids = np.array([*range(words), a_model(words).common])
    return [rng.choice(ids, rng.choice([1, 2, 5, 30, 200])).astype(np.int32) for _ in range(n)]


def test_probabilities_sum_to_one():
    model = a_model()
    ids = [*range(11), model.common]
    assert math.isclose(sum(math.exp(sum(slow_logs(model, [a, b]))) for a in ids for b in ids), 1, rel_tol=1e-6)


@pytest.mark.parametrize(("lanes", "window"), [(1, 7), (8, 24), (64, 3), (512, 1)])
def test_scores_of_whole_documents(monkeypatch, lanes, window):
    monkeypatch.setattr(G, "WINDOW", window)
    model, docs = a_model(), some_docs(1)
    assert np.allclose(G.score(model, docs, lanes), [sum(slow_logs(model, d)) for d in docs], rtol=1e-4)


def test_gradients_against_differences():
    model, docs = a_model(), some_docs(2, 6)
    before, starts, targets, which = next(G.windows(docs, model.start, 4, 9))
    live, state = which >= 0, np.zeros((model.hidden, before.shape[1]))
    wide = model.like(model.weights.astype(np.float64))
    logs = lambda m: G.log_probabilities(m, G.by_number(G.Pass(m, before, starts, state).states)[:, live.ravel()], targets[live])
    grad, _, loss = G.gradients(wide, before, starts, targets, live, state)
    assert math.isclose(loss, -logs(wide).sum(), rel_tol=1e-5)
    rng = np.random.default_rng(4)
    for i in [*rng.choice(np.flatnonzero(np.abs(grad) > 1e-2), 40), *rng.choice(len(grad), 10)]:
        side = []
        for step in (1e-2, -1e-2):
            moved = wide.like(wide.weights.copy())
            moved.weights[i] += step
            side.append(-logs(moved).sum())
        assert math.isclose((side[0] - side[1]) / 2e-2, grad[i], rel_tol=0.03, abs_tol=0.01)


def test_training_learns_order():
    docs = [np.tile(np.array([0, 3, 6, 9], dtype=np.int32), 20) for _ in range(60)]
    trainer = G.Trainer(G.untrained(np.full(10, 100), 5, 8, 3))
    first = G.score(trainer.model, docs[:1])[0] / 80
    for _ in range(60):
        trainer.learn(docs)
        trainer.step()
    assert first < -2 and G.score(trainer.model, docs[:1])[0] / 80 > -0.1


def test_base_against_plain_code(docs_of, monkeypatch):
    monkeypatch.setattr(G, "FLUSH", 50)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "The the THE tHe", "É é", "a\x0bb\x85c", "one two"] * 8)]
    rows += [(100 + i, f"common words w{i} w{i % 7}") for i in range(60)] + [(None, "no id"), (3, "again"), (3, "again"), (500, "long text " * 30_000)]
    for counted, vocabulary in ((5, 3), (65536, 2048)):
        got = G.score_documents(docs_of([(i, t, "en", "s") for i, t in rows]), vocabulary, counted).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2:])
        for g, w in zip(sorted(map(tuple, got), key=key), sorted(base(rows), key=key), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] < 0


def test_without_training_documents(docs_of):
    assert G.score_documents(docs_of([])).collect() == []
    alone = next(i for i in range(100) if held(i))
    (row,) = G.score_documents(docs_of([(alone, "no one learns", "en", "s")])).collect()
    assert row.held_out and row.train_tokens == row.n_known == 0 and row.n_tokens == 4 and row.base_score == 0 and abs(row.score) < 1e-6


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 50 + [2] * 9 + [7, 7, 9, 1000])], "word string, n long")
    assert [r.n for r in G.most_frequent(counts, 100)] == [1000, 9, 7, 7] + [2] * 9 + [1] * 50
    assert [(r.word, r.n) for r in G.most_frequent(counts, 12)] == [("w62", 1000), ("w61", 9), ("w59", 7), ("w60", 7)]
    assert G.most_frequent(counts.where("n = 1"), 12) == [] == G.most_frequent(counts.limit(0), 12)


def test_copies_are_averaged_by_weight(spark, monkeypatch):
    monkeypatch.setattr(G, "AVERAGED", 2)
    rng = np.random.default_rng(1)
    models, weights = rng.normal(size=(5, 2, 6)).astype(np.float32), [1.0, 2.0, 5.0, 0.5, 3.0]
    rows = [(p, c, weights[p], models[p, c].tobytes()) for p in range(5) for c in range(2)]
    got = G.averaged(spark.createDataFrame(rows, "part long, chunk int, weight double, numbers binary"), 4)
    assert np.allclose(got, np.average(models, axis=0, weights=weights).ravel(), rtol=1e-5)


def test_held_out_documents_score_better_than_by_words_alone(spark):
    got = op13(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for g, w in zip(sorted(map(tuple, got)), sorted(base(rows)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score - r.base_score for r in out) / n > 0.1
    assert sum(r.score > r.base_score for r in out) > 0.8 * len(out)
