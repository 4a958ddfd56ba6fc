"""op8's counts and digest are of the spans the contract names, whatever stands before them."""

import hashlib
import random
import re

from footbridge.llm.queries import op8

KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
RULES = [
    ("assign", re.compile(rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def slow(text):
    found = [(m.start(), i, m.end()) for i, (_, rule, holds) in enumerate(RULES) for m in rule.finditer(text or "") if holds(m)]
    listed = ",".join(f"{RULES[i][0]}:{a}:{b}" for a, i, b in sorted(found))
    return (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(listed.encode()).hexdigest())


def test_counts_are_by_kind(spark, tmp_path):
    bits = ["token", "API_KEY", "Secret", "=", ": ", "'", " ", "\n", "AKIA" + "Z9" * 7, "AKIA", "0f" * 20, "abcdefgh", "abc", "é", "😀", "K", "-"]
    rng = random.Random(3)
    texts = [None, "", "AKIA" + "A" * 12, "0f" * 16, "token=abcdefgh token=abcdefgh", *("".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in op8(spark, str(tmp_path)).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}
