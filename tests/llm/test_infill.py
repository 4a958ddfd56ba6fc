import hashlib
import random
import re

import pytest

from footbridge.llm import infill
from footbridge.llm.queries import op11


def slow(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20000])
def test_every_rank_of_the_list(n):
    rng = random.Random(n)
    widths = [rng.randrange(4) for _ in range(n)]
    made, total = infill.SkipList(widths), 0
    for rank in range(n + 1):
        assert made.points_before(rank) == total
        total += widths[rank] if rank < n else 0
    with pytest.raises(IndexError):
        made.points_before(n + 1)


def test_lanes_thin_out():
    made = infill.SkipList([1] * 100_000)
    sizes = [len(lane) for lane in made.units]
    assert sizes[0] == 100_000 and all(sum(lane) <= 100_000 for lane in made.units) and 20_000 < sizes[1] < 30_000 and 1000 < sizes[3] < 2200


def test_against_plain_code(docs_of):
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "é\n😀x\r\n\ny", "a\r\nb", "has <S> in it\nand more", "<P\nS>\n<", "x<\n<P\n", "<M>", "line\n" * 100_000 + "end", " \x0b\n\x85\n z\n"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts * 9)] + [(None, "a\nb\nc", "en", "s"), (3, "a\nb\nc", "en", "s"), (3, "a\nb\nc", "en", "s")]
    out = infill.transform(docs_of(rows))
    got = out.withColumn("back", infill.restored(out.form, out.output)).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(((i, *slow(i, t)) for i, t, *_ in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    text_of = {i: t or "" for i, t, *_ in rows}
    assert all(r.back == (text_of[r.doc_id] if r.doc_id != 3 else r.back) for r in got)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert infill.transform(docs_of([])).collect() == []


def test_shares(docs_of):
    out = infill.transform(docs_of([(i, "a\nb", "en", "s") for i in range(2000)]), rate=40, spm=10).groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in out}
    assert 1100 < n["plain"] < 1300 and 650 < n["psm"] < 790 and 50 < n["spm"] < 115


def test_given_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op11(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, p, m, output = slow(r.doc_id, rows[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, digest(output), digest(rows[r.doc_id] or ""))
