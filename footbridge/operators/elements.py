"""Loading and scoping map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footbridge.model import INHERITED_KEYS
from footbridge.functions.tags import has_tag, tag
from footbridge.operators.spatial import points_in_rings


def load_entities(rows: DataFrame, key: str | list[str], order_col: str) -> DataFrame:
    """Keyed load where the last write wins; ties go to the larger row value."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    # max_by keeps one row per key on the map side, so a hot key never travels whole
    latest = F.max_by(F.struct(*rest), F.col(order_col)).alias("row")
    return rows.groupBy(*keys).agg(latest).select(*keys, "row.*").select(*rows.columns)


def replace_members(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Members of every re-loaded relation are replaced whole, so no stale tail stays."""
    reloaded = incoming.select("relation_id").distinct()
    return current.join(reloaded, "relation_id", "left_anti").unionByName(incoming)


def flatten_members(relations: DataFrame) -> DataFrame:
    """``members array<struct<type,ref,role>>`` to one row per member with its ordinal."""
    return relations.select(
        F.col("id").alias("relation_id"), F.posexplode("members").alias("sequence", "m")
    ).select(
        "relation_id", "sequence",
        F.upper(F.substring("m.type", 1, 1)).alias("member_type"),
        F.col("m.ref").alias("member_ref"),
        F.coalesce("m.role", F.lit("")).alias("member_role"),
    )


def _matches_scope(tags: str, scope: dict[str, list[str] | None]):
    hit = F.lit(False)
    for key, values in scope.items():
        part = has_tag(tags, key) if values is None else F.coalesce(tag(tags, key).isin(*values), F.lit(False))
        hit = hit | part
    return hit


def scope_by_tags(
    nodes: DataFrame, ways: DataFrame, scope: dict[str, list[str] | None]
) -> tuple[DataFrame, DataFrame]:
    """Elements matching the key/value scope, plus the nodes the kept ways refer to.

    ``scope`` maps a tag key to its admitted values, or to None for any value.
    """
    kept_ways = ways.where(_matches_scope("tags", scope))
    used = kept_ways.select(F.explode("nodes").alias("id")).distinct()
    own = nodes.where(_matches_scope("tags", scope)).select("id")
    wanted = own.unionByName(used).distinct()
    return nodes.join(wanted, "id", "left_semi"), kept_ways


def clip_complete_ways(
    nodes: DataFrame, ways: DataFrame, ring: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Ways with any node inside the ring, completed with all of their nodes.

    ``ring`` has ``ring_id, pos, lat, lon``. Inside nodes are kept even when no way uses them.
    """
    inside = points_in_rings(nodes.select("id", "lat", "lon"), ring).select("id").distinct()
    refs = ways.select(F.col("id").alias("way_id"), F.explode("nodes").alias("id"))
    hit = refs.join(inside, "id", "left_semi").select("way_id").distinct()
    kept = ways.join(hit.withColumnRenamed("way_id", "id"), "id", "left_semi")
    wanted = kept.select(F.explode("nodes").alias("id")).unionByName(inside).distinct()
    return nodes.join(wanted, "id", "left_semi"), kept


def still_to_do(universe: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet: run these and append."""
    return universe.join(done.select(key).distinct(), key, "left_anti")


def stations_named(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Station relations carrying one of the names; a name may return several."""
    kept = relations.where(tag("tags", "public_transport").isin("stop_area", "stop_area_group"))
    return kept.select(
        F.col("id").alias("relation_id"), tag("tags", "name").alias("name")
    ).join(names.select("name").distinct(), "name")


def propagate_tags(ways: DataFrame, members: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Untagged member ways inherit walk-relevant tags of their lowest-id multipolygon.

    Returns the updated ways and the audit table of touched way ids.
    """
    parents = relations.where(tag("tags", "type") == "multipolygon").select(
        F.col("id").alias("relation_id"),
        F.map_filter("tags", lambda k, v: k.isin(*INHERITED_KEYS)).alias("inherited"),
    )
    outer = members.where(F.col("member_type") == "W").select("relation_id", F.col("member_ref").alias("id"))
    bare = ways.where(F.size("tags") == 0).select("id")
    source = (
        outer.join(parents, "relation_id").join(bare, "id", "left_semi")
        .groupBy("id").agg(F.min_by("inherited", "relation_id").alias("inherited"))
        .where(F.size("inherited") > 0)
    )
    updated = ways.join(source, "id", "left").select(
        "id", "nodes", F.coalesce("inherited", "tags").alias("tags")
    )
    return updated, source.select(F.col("id").alias("way_id"))


def revert_tags(ways: DataFrame, touched: DataFrame) -> DataFrame:
    """Make every recorded way untagged again."""
    mark = touched.select(F.col("way_id").alias("id"), F.lit(True).alias("hit")).distinct()
    empty = F.expr("cast(map() as map<string,string>)")
    return ways.join(mark, "id", "left").select(
        "id", "nodes", F.when(F.col("hit"), empty).otherwise(F.col("tags")).alias("tags")
    )
