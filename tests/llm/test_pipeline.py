import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
from test_near_copies import slow_kept
from test_secrets import slow_all
from tokenizers import Tokenizer

import corpus_pipeline as P
from footbridge.llm import markov_secrets as M
from footbridge.llm.sql import MIXING, QUALITY_RULES
from footbridge.session import cut

SF = "/root/testdata/sf0.001"


def in_duckdb(rows, sql):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    return con.execute(sql)


def masked(text, ratios):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in slow_all(text, ratios).split(",") if s)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_each_stage_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    columns = docs.columns

    def stage(name, docs):
        out = cut(dict(P.STAGES)[name](spark, docs, SF))
        return out, [r.asDict() for r in out.collect()]

    good, got = stage("quality_rules", docs)
    want = {r[0] for r in in_duckdb(list(rows.values()), f"select doc_id from ({QUALITY_RULES}) where kept").fetchall()}
    assert good.columns == columns and {r["doc_id"] for r in got} == want and len(got) == len(want)

    single, got = stage("simhash_near_dedup", good)
    want = slow_kept({i: rows[i]["text"] for i in want})
    assert single.columns == columns and {r["doc_id"] for r in got} == want and len(got) == len(want)

    ratios = M.train(M.samples(single))
    clean, got = stage("secret_scans", single)
    texts = {i: masked(rows[i]["text"], ratios) for i in want}
    assert clean.columns == columns and {r["doc_id"]: r["text"] for r in got} == texts

    mix, copies = stage("mixing", clean)
    taken = in_duckdb(got, f"select doc_id, taken // size from ({MIXING}) where taken > 0").fetchall()
    assert mix.columns == columns and Counter(r["doc_id"] for r in copies) == Counter(dict(taken))

    _, got = stage("bpe", mix)
    plain, digest = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in copies:
        ids = plain.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(plain.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r.values()) for r in got) == sorted(want)
    assert sorted(tuple(r) for r in P.run(spark, SF).collect()) == sorted(want)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
