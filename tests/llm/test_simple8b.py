import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from footbridge.llm import simple8b as S

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a  b\n c   d\n\n e \n f <|endoftext|> x<|endoftext|>y\tz \x1c q é\xa0é 　x", "", " ", "\n", " a", "a ", None, "a\n b", "x\ny\nx", "It's <|endoftext|", "aa\r\nb\tc",
    "x " * 40000 + " y", "word " * 20000 + "b" * 3000, "same", "same",
]


def greedy(ids, block):
    """Word by word: how many ids each word takes, 0 for an escape's head."""
    out = []
    for a in range(0, len(ids), block):
        part, i, run = ids[a : a + block], 0, False
        while i < len(part):
            for s in range(1, 15):
                take = part[i : i + int(S.COUNTS[s])]
                if all(x >> int(S.WIDTHS[s]) == 0 for x in take):
                    out.append(len(take))
                    i, run = i + len(take), False
                    break
            else:
                out += [1] if run else [0, 1]
                i, run = i + 1, True
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=200), st.sampled_from([5, 64, 4096]))
def test_round_trip(ids, block):
    words, offsets = S.pack(np.array(ids, dtype=np.uint64), block)
    assert len(words) == len(greedy(ids, block)) and len(offsets) == -(-len(ids) // block)
    assert S.unpack(words, offsets, len(ids), block).tolist() == ids


def test_long_runs_and_bad_words():
    ids = np.concatenate([np.full(5000, 2**64 - 1, dtype=np.uint64), np.zeros(9000, dtype=np.uint64)])
    words, offsets = S.pack(ids)
    assert (S.unpack(words, offsets, len(ids)) == ids).all() and len(words) == 5000 + 2 + 152
    with pytest.raises(ValueError):
        S.unpack(np.array([15 << 60], dtype=np.uint64), np.array([0]), 1)


def test_files_equal_the_library(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 50)
    rows = [(100 - i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (90, "again", "en", "s")]
    plain = Tokenizer.from_file(PATH)
    got = S.write_and_read(docs_of(rows).repartition(5), PATH, str(tmp_path / "f")).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    texts, start = {}, 0
    for i, t, _, _ in rows:
        texts.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        texts[r.doc_id].remove(bytes(r.ids))
        start += r.n_tokens
    assert S.write_and_read(docs_of([]), PATH).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in S.write_and_read(docs, PATH).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        assert (got[r.doc_id].start, zlib.crc32(got[r.doc_id].ids)) == (start, zlib.crc32(ids))
        start += len(ids) // 4
