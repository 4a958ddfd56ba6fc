"""Station search over folded name keys, for whole batches of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions import tags as tg
from footbridge.functions.text import fold_key, fold_name
from footbridge.session import cut

_GRAM = 3


def search_keys(stations: DataFrame) -> DataFrame:
    """(station, key) rows: the folded name, and the alias where folding makes it differ.

    ``stations`` has ``idx, name, alias, is_main``.
    """
    own, other = fold_name(F.col("name")), fold_name(F.trim(F.coalesce("alias", F.lit(""))))
    keys = F.when((other == "") | (other == own), F.array(own)).otherwise(F.array(own, other))
    return stations.select("idx", "is_main", own.alias("own_key"), F.explode(keys).alias("key"))


def _grams(text):
    """All distinct substrings of one to three characters."""
    def of_length(n: int):
        pieces = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, pieces).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, _GRAM + 1)]))


def _hits(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys containing a term. Both meet on a short gram, so no nested loop is planned.

    A term is looked up by its rarest gram of the indexed length.
    """
    q = terms.select("term", fold_name(F.trim("term")).alias("q")).where("q <> ''").distinct()
    index = keys.withColumn("gram", F.explode(_grams(F.col("key"))))
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    width = F.least(F.length("q"), F.lit(_GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("q") - width + 1), lambda i: F.substring(F.col("q"), i, width))
    probes = q.withColumn("gram", F.explode(F.array_distinct(own))).join(sizes, "gram", "left")
    # a gram nobody has means no hit, and the smallest posting list is read otherwise
    rarest = probes.groupBy("term", "q").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").where(F.col("key").contains(F.col("q"))).drop("gram")


def _best(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` stations of each ``by``, with the key that places each: main ones first, then by key.

    Each station counts once; ranks are cut before the shuffle too, so a node that most names pass costs no more."""
    one = rows.groupBy(by, "idx").agg(F.min(F.struct((~F.col("is_main")).alias("minor"), "key")).alias("at"))
    ranked = Window.partitionBy(by).orderBy("at", "idx")
    return one.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= n).select(by, "idx", "at.minor", "at.key")


def name_trie(keys: DataFrame, n: int) -> DataFrame:
    """A node for every prefix of a key, with its best ``n`` stations: ``node, idx, minor, key``."""
    upto = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))
    nodes = keys.where("key <> ''").select("idx", "is_main", "key", F.explode(upto).alias("node"))
    return _best(nodes, "node", n)


def search_stations(terms: DataFrame, keys: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` stations per term: prefix before inner matches, main before minor, then name.

    A term's node of the trie has its prefix matches. Only a term with fewer than ``n`` of them looks further: one no
    longer than a gram reads the head of that gram's postings, which holds enough stations beside its own few prefix
    matches, and a longer one the postings of its rarest gram."""
    q = terms.select("term", fold_name(F.trim("term")).alias("q")).where("q <> ''").distinct()
    led = cut(q.join(name_trie(keys, n).withColumnRenamed("node", "q"), "q"))
    full = led.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
    open_ = cut(q.join(full, "term", "left_anti"))
    heads = _best(keys.withColumn("gram", F.explode(_grams(F.col("key")))), "gram", 2 * n)
    near = open_.where(F.length("q") <= _GRAM).join(heads.withColumnRenamed("gram", "q"), "q")
    far = _hits(open_.where(F.length("q") > _GRAM).select("term"), keys).withColumn("minor", ~F.col("is_main"))
    columns = ["term", "q", "idx", "minor", "key"]
    found = led.select(columns).unionByName(near.select(columns)).unionByName(far.select(columns))
    order = F.struct((~F.col("key").startswith(F.col("q"))).alias("inner"), "minor", "key", "idx")
    best = found.groupBy("term", "idx").agg(F.min(order).alias("o"))
    ranked = Window.partitionBy("term").orderBy("o")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n).select("term", "idx", "rank")


def resolve_names(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """The one station a name means: an exact key (main, own name, earliest), else the best hit."""
    q = terms.select("term", fold_name(F.trim("term")).alias("key")).distinct()
    order = F.struct((~F.col("is_main")).alias("minor"), (F.col("own_key") != F.col("key")).alias("by_alias"), "idx")
    # both are read several times below
    exact = cut(q.join(keys, "key").groupBy("term").agg(F.min_by("idx", order).alias("idx")).withColumn("how", F.lit("exact")))
    misses = cut(terms.select("term").distinct().join(exact, "term", "left_anti"))
    found = search_stations(misses, keys, 1).select("term", "idx").withColumn("how", F.lit("search"))
    return exact.unionByName(found)


def station_catalog(rows: DataFrame) -> DataFrame:
    """Suggestable catalogue rows with coordinates; an alias only where it adds something."""
    def text(c: str):
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    alias = text("alias")
    return rows.where("suggestable").where(text("latitude").isNotNull() & text("longitude").isNotNull()).select(
        "id", "name", text("latitude").cast("double").alias("latitude"), text("longitude").cast("double").alias("longitude"),
        "country", text("db_id").alias("db_id"), "is_main",
        F.when(fold_name(alias) != fold_name(F.col("name")), alias).alias("alias"))


def map_station_index(station_points: DataFrame, relations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Named map stations as catalogue rows, route-like names left out, with their search keys.

    Stations already in ``known`` (``relation_id``) are skipped, so re-running adds nothing.
    """
    named = station_points.join(
        relations.select(F.col("id").alias("relation_id"), tg.tag("tags", "name:en").alias("name_en")), "relation_id")
    route = r"(->|→)"
    kept = named.where(
        F.col("name").isNotNull() & ~F.col("name").rlike(route) & ~F.coalesce("name_en", F.lit("")).rlike(route)
        & ((F.trim("name") != "") | (F.trim(F.coalesce("name_en", F.lit(""))) != "")))
    if known is not None:
        kept = kept.join(known.select("relation_id").distinct(), "relation_id", "left_anti")
    local, english = F.trim("name"), F.nullif(F.trim("name_en"), F.lit(""))
    both = F.filter(F.array(local, english), lambda v: v.isNotNull() & (v != ""))
    keys = F.array_distinct(F.filter(F.flatten(F.transform(
        both, lambda v: F.array(fold_name(v), fold_key(v)))), lambda k: k != ""))
    return kept.select(
        F.concat(F.lit("osm-r"), "relation_id").alias("id"), "relation_id", F.coalesce(english, local).alias("name"),
        "lat", "lon", "country", (F.coalesce("n_members", F.lit(0)) >= M.MAIN_STATION_MEMBERS).alias("is_main"), keys.alias("keys"))
