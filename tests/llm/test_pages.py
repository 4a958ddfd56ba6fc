import duckdb
import pytest

from footbridge.llm import lang_evidence as L
from footbridge.llm import url_trust as U
from footbridge.llm.sql import RULES, URL_TRUST

COLUMNS = "page_id long, url string, html string, host string, lang string, n string, rule string"
LINKS = '<a href="http://Bad.example.org/x">b</a> <img src=//good.org/i.png><a href="/own">o</a>'
PAGES = [
    (1, "HTTP://A.Example.ORG/es/1?q#f", LINKS), (2, "http://good.org", LINKS), (3, "http://good.org/", LINKS), (4, None, LINKS), (5, "no scheme", None), (6, "://", ""),
    (7, "http://example.org/en/12", None), (8, "http://x.net/p", '<a href="https://good.org">g</a>'), (9, "http://y.net?x/", '<a href="http://a.example.org/es">g</a>'), (9, "http://y.net?x/", None),
    (None, "http://b.a.example.com/de/1\n2", None), (10, "http://z.net/", "<a href='HTTP://Y.net/'>" * 5000), (11, "x://q://r/", None), (12, "http://notexample.org/es/", None),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", "w") for i, u, h in rows], COLUMNS)


def rules_of(spark):
    return spark.createDataFrame(RULES, "rule string, verdict string")


def test_verdicts_match_sql(spark):
    pages = pages_of(spark, PAGES)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    want = sorted(map(repr, con.sql(f"select page_id, host, path, rule, verdict from ({URL_TRUST})").fetchall()))
    got = U.judge(pages, rules_of(spark)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    by = {r.page_id: r for r in got}
    assert by[1].verdict == "block" and by[3].rule == "org/" and by[2].rule is None and by[7].verdict == "block" and by[12].verdict == "allow"
    assert (by[8].verdict, by[9].verdict, by[10].verdict) == ("allow", "block", "block")
    assert U.judge(pages_of(spark, []), rules_of(spark)).collect() == []


def test_mass_of_one_seed_among_many_passes_hubs_and_long_ways(spark):
    """One page of ten million is blocked; its host links to a hundred thousand subdomains, one of which starts a chain of 25 links."""
    seeds = spark.createDataFrame([("distrust", "bad", 1), ("distrust", "far", 10**7 - 1)], "kind string, host string, n long")
    fan = spark.range(100_000).selectExpr("'distrust' kind", "'bad' src", "concat('s', id) dst")
    chain = spark.range(25).selectExpr("'distrust' kind", "if(id = 0, 's7', concat('c', id)) src", "concat('c', id + 1) dst")
    got = {r.host: int(r.mass) for r in U.walk(seeds, fan.unionByName(chain)).where("host in ('bad', 'far', 's7', 's8', 'c1', 'c25')").collect()}
    keep, one = U.KEEP / 100, U.UNIT / 10**7
    want = {"bad": one, "far": U.UNIT - one, "s7": one * keep / 1e5, "s8": one * keep / 1e5, "c1": one * keep**2 / 1e5, "c25": one * keep**26 / 1e5}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(m * (1 - keep), rel=1e-6) for h, m in want.items() if h != "c25")
    assert 0 <= got["c25"] <= want["c25"]


def test_a_round_reads_the_round_before_once(spark, monkeypatch):
    """The plan of the rounds between two cuts grows by one read of the steps a round, not twofold."""
    leaves, write = [], U.materialise

    def watched(df, **metrics):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return write(df, **metrics)

    monkeypatch.setattr(U, "materialise", watched)
    seeds = spark.createDataFrame([("trust", "a", 2), ("trust", "lone", 1)], "kind string, host string, n long")
    edges = spark.createDataFrame([("trust", "a", "b"), ("trust", "b", "a"), ("trust", "a", "c")], "kind string, src string, dst string")
    got = {r.host: int(r.mass) for r in U.walk(seeds, edges).collect()}
    assert max(leaves[1:]) <= U.CUT_EVERY + 1
    # of what reaches a host all but 85 % stays; c and lone pass nothing on
    a = 2 / 3 / (1 - 0.85**2 / 2)
    want = {"a": a, "b": a * 0.425, "c": a * 0.425, "lone": 1 / 3}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(0.15 * U.UNIT * m, rel=1e-3) for h, m in want.items())


def test_longest_rule_wins(spark):
    rules = spark.createDataFrame([("org/", "block"), ("a.org", "allow"), ("a.org/x", "block"), ("b/", "allow")], "rule string, verdict string")
    rows = [(1, "s://a.org/y", None), (2, "s://q.a.org/xy", None), (3, "s://b/", None), (4, "s://a.org", None), (5, "s://c.org/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages_of(spark, rows), rules).collect()}
    assert got == {1: ("a.org", "allow"), 2: ("a.org/x", "block"), 3: ("b/", "allow"), 4: ("a.org", "allow"), 5: ("org/", "block")}


def test_languages_of_unseen_documents(spark):
    """Documents that training skipped, as bare pages: the text alone has to tell."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    pages = test.selectExpr("doc_id page_id", "cast(null as string) url", "text html")
    right = [r.lang == r.got for r in L.identify(pages, train).selectExpr("page_id doc_id", "lang got").join(test, "doc_id").collect()]
    assert len(right) > 300 and sum(right) >= 0.98 * len(right)


def test_pages_of_given_table(spark):
    sf = "/root/testdata/sf0.01"
    got = L.identify(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sum(r.lang == r.declared for r in got) >= 0.97 * len(got)


def slow_fuse(voted, langs):
    """The posterior's winner by plain loops."""
    import math

    def tally(key):
        n = {}
        for v in voted:
            if v["text_lang"] and v[key] is not None:
                n.setdefault(v[key], dict.fromkeys(langs, 0))[v["text_lang"]] += 1
        return n

    hosts = tally("host")
    domains = {}
    for h, n in hosts.items():
        d = domains.setdefault(".".join(h.split(".")[-2:]), dict.fromkeys(langs, 0))
        for x in langs:
            d[x] += n[x]
    total = {x: sum(d[x] for d in domains.values()) for x in langs}
    base = {x: (total[x] + 1) / (sum(total.values()) + len(langs)) for x in langs}
    smooth = lambda n, up: {x: (n[x] + L.WEIGHT * up[x]) / (sum(n.values()) + L.WEIGHT) for x in langs}
    out = {}
    for v in voted:
        h = v["host"]
        prior = smooth(hosts[h], smooth(domains[".".join(h.split(".")[-2:])], base)) if h in hosts else base
        logs = {x: math.log(prior[x]) + t for x, t in zip(langs, v["text"], strict=True)}
        for key in ("declared", "suffix"):
            n = tally(key)
            if v[key] in n:
                for x in langs:
                    logs[x] += math.log((n[v[key]][x] + 1 / len(n)) / (sum(m[x] for m in n.values()) + 1))
        top = max(logs.values())
        out[v["page_id"]] = (min(x for x in langs if logs[x] == top), 1 / sum(math.exp(x - top) for x in logs.values()))
    return out


def test_fusion_matches_plain_loops(spark):
    langs = ["de", "en", "fr"]
    rows = []
    for i in range(120):
        best = [0, 1, 1, 2][i % 4]
        text = [float(-3 - (j != best) * (i % 5)) for j in range(3)]
        host = [f"a{i % 7}.b{i % 3}.net", "solo", "", f"x{i}.com"][i % 4 if i % 9 else 2]
        rows.append((i, host, host.split(".")[-1], [None, "de", "en", "zz"][i % 4], text, langs[best] if max(text) > min(text) else None))
    voted = spark.createDataFrame(rows, "page_id long, host string, suffix string, declared string, text array<double>, text_lang string")
    want = slow_fuse([r.asDict() for r in voted.collect()], langs)
    got = {r.page_id: (r.lang, r.confidence) for r in L.fuse(voted, langs).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_language_edges(spark, docs_of):
    docs = docs_of([(1, "der die das und ist nicht " * 9, "de", "s"), (2, "the and of that is not " * 9, "en", "s"), (3, None, "fr", "s"), (None, "x", None, None)])
    rows = [(1, "http://a.de/", '<html lang="de-AT"><body>das ist nicht die</body>'), (2, None, None), (3, "", ""), (3, "", ""), (4, "http://b.com", "<p>" + "the that of " * 30000 + "</p>")]
    got = {r.page_id: r for r in L.identify(pages_of(spark, rows), docs).collect()}
    assert got[1].lang == "de" and got[1].declared == "de" and got[4].lang == "en" and got[2].text_lang is None and got[2].lang in ("de", "en")
    assert L.identify(pages_of(spark, []), docs).collect() == []
    assert {r.lang for r in L.identify(pages_of(spark, rows), docs_of([])).collect()} == {None}
