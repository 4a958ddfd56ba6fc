import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from footbridge.llm import bpe_index as B

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's  a Test\n ΣΑΣ <|endoftext|> x<|startoftext|>y İ 12 a\x1cb \x85 é é 日本 😀!!", "", None, "aaaa aaaaaaa hahahahaha", " \t\n",
    "don't I'LL we're ’s ٣٤ ½ Ⅷ ​ x ǅ ẞ ﬁ ẹ́ ́a 가나", "x", "x", "<|endoftext", "word " * 30000 + "b" * 5000,
]


def test_ids_and_texts_equal_the_library(spark, docs_of):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "a null id", None, None)]
    plain = Tokenizer.from_file(PATH)
    want = {}
    for i, t, _, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), back)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(docs_of(rows), PATH).collect()}
    assert got == want
    assert B.digests(docs_of([]), PATH).collect() == []


def test_given_documents_equal_the_library(spark):
    plain = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in B.encode(docs, PATH).collect():
        assert r.ids == plain.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 3)
    vocab, plain = B.Vocabulary(PATH), Tokenizer.from_file(PATH)
    for text in ["one two three four five", "six one seven", "one eight nine", "two two one ten", "ten six"]:
        assert B.lists(vocab.encode([text])).to_pylist() == [plain.encode(text, add_special_tokens=False).ids]


def test_decode_alone(spark):
    rows = spark.createDataFrame([(1, [320, 99999, 568, -1], "x"), (2, None, "x"), (3, [], "x"), (4, [49407], "x")], "doc_id long, ids array<int>, decoded string")
    tokens = B.vocabulary(PATH).tokens
    assert {r.doc_id: r.decoded for r in B.decode(rows, PATH).collect()} == {1: f"{tokens[320]} {tokens[568]}", 2: "", 3: "", 4: "<|endoftext|>"}
