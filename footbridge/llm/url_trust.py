"""URL filters: rules, and trust carried over the links between hosts for what no rule decides.

A rule is a host and a path prefix; it fits the host and all its subdomains, and the longest fitting rule wins. Hosts of
pages that a rule allows are seeds of trust, those of blocked pages seeds of distrust, each by its share of such pages.
Trust walks forward over host edges, distrust backward, as personalised PageRank: links to blocked hosts taint. Host
edges are the distinct hosts a host's pages link to, and a host and its registered domain, which vouch for each other.
A host is blocked if its distrust exceeds its trust.

Mass is counted in whole units of 10^-26, decimals of 38 digits, and divided by floor, so results do not depend on the order of
sums and a seed among billions still passes shares on through hubs. A host keeps part of the mass that reaches it; the rest walks on until
what still walks is, at every host, less than a stated share of what the host has, however many rounds that takes. Edges are made distinct with partial
aggregation; hosts with many pages are one node. Every few rounds are written to the shared folder, and what still walks is
observed there.

Defined results: a null url, or one without ://, has an empty host and path and is allowed unless a rule fits it; a null
page has no links. Of rules of equal length the one of the longer host wins. Repeated rows are judged each. Empty
tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footbridge.llm.columns import pruned
from footbridge.session import cut, materialise

UNIT = 10**26
KEEP = 85  # per cent of a host's mass that walks on each round
SETTLED = 10**-4  # the share of a host's mass that may still walk at the end; a host just reached has walking mass only
CUT_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict) with rule_host and rule_path."""
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    return rules.select("rule", "verdict", host.alias("rule_host"), F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit("")).alias("rule_path"))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host (rows of host) the rules that fit it, longest first: host, rules."""
    depth = rules.select(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    joined = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    sized = F.struct((-F.length("rule")).alias("order"), (-F.length("rule_host")).alias("tie"), "rule", "verdict", "rule_path")
    return joined.groupBy("host").agg(F.sort_array(F.collect_list(sized)).alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) hosts: hyperlinks and addresses of parts of the pages, and hosts with their domains."""
    host = host_of(F.col("url"))
    away = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    away = away.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    up = pages.select(host.alias("src")).distinct().select("src", domain_of(F.col("src")).alias("dst"))
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = away.unionByName(up.select(F.inline(both)))
    return edges.where("src <> dst and src <> '' and dst <> ''").distinct()


def shares(units: Column, parts: Column) -> Column:
    """Whole units divided by floor; both of their quotient's operands are exact."""
    parts = parts.cast("decimal(20,0)")
    return ((units - units % parts) / parts).cast("decimal(38,0)")


def walk(seeds: DataFrame, edges: DataFrame, settled: float = SETTLED) -> DataFrame:
    """(kind, host, mass) after personalised PageRank of each kind from its seeds (kind, host, n) over (kind, src, dst)."""
    units = lambda c: c.cast("decimal(38,0)")
    none = units(F.lit(0))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    given = units(units(F.lit(str(UNIT))) * F.col("n").cast("decimal(20,0)"))
    start = seeds.join(total, "kind").select("kind", "host", none.alias("mass"), shares(given, F.col("total")).alias("walking"))
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    # a host's step to itself carries what it keeps, so a round reads the round before once and the plan grows by one join a round
    here = seeds.select("kind", F.col("host").alias("src")).unionByName(edges.select("kind", "src")).unionByName(edges.select("kind", F.col("dst").alias("src")))
    here = here.distinct().select("kind", "src", F.col("src").alias("dst"), F.lit(None).cast("long").alias("degree"))
    steps = cut(edges.join(degree, ["kind", "src"]).select("kind", "src", "dst", "degree").unionByName(here))
    left = F.coalesce(F.max(F.try_divide(F.col("walking").cast("double"), (F.col("mass") + F.col("walking")).cast("double"))), F.lit(0.0))
    table, seen = materialise(start, left=left)
    while seen["left"] > settled:
        for _ in range(CUT_EVERY):
            stays = shares(units(F.col("walking") * (100 - KEEP)), F.lit(100))
            moves = shares(units(F.col("walking") * KEEP), F.col("degree") * 100)
            own = F.col("degree").isNull()
            passed = table.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), F.when(own, units(F.col("mass") + stays)).otherwise(none).alias("mass"), F.when(own, none).otherwise(moves).alias("walking"))
            table = passed.groupBy("kind", "host").agg(units(F.sum("mass")).alias("mass"), units(F.sum("walking")).alias("walking"))
        table, seen = materialise(table, left=left)
    return table.select("kind", "host", "mass")


def judge(pages: DataFrame, rules: DataFrame, settled: float = SETTLED) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, by ``rules`` of (rule, verdict allow or block) and trust."""
    pages = pruned(pages, "page_id", "url", "html")
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut(placed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    # written, so that Spark knows their true sizes before it plans the joins with the pages
    fit = cut(fitting(hosts.select("host"), rule_table(rules)))
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    ruled = placed.join(fit, "host", "left").select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("ruling"))
    kinds = F.create_map(F.lit("allow"), F.lit("trust"), F.lit("block"), F.lit("distrust"))
    seeds = ruled.where("ruling is not null").groupBy(kinds[F.col("ruling")].alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    forward = links(pages)
    edges = forward.select(F.inline(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))))
    mass = walk(seeds, edges, settled)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0))
    scores = cut(mass.groupBy("host").agg(side("trust").alias("trust"), side("distrust").alias("distrust")))
    verdict = F.coalesce("ruling", F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
