"""Journeys: changes of train, their walks, verdicts and re-assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footbridge import model as M
from footbridge.functions.geo import haversine
from footbridge.functions.text import track_ref
from footbridge.functions.times import layover


def interchanges(legs: DataFrame, walking: str = "walking") -> DataFrame:
    """Each pair of consecutive train legs of a journey, with the walk legs between them summed.

    ``legs`` has ``journey_id, leg_no, mode``, the ``dep_``/``arr_`` platform, lat, lon, time and
    late columns, and the walk legs' ``distance_m`` and ``duration_s``. One shuffle by journey
    serves all windows; a journey has a handful of legs.
    """
    order = Window.partitionBy("journey_id").orderBy("leg_no")
    train = F.col("mode") != walking
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trains = legs.withColumn("_n", F.sum(F.when(train, 1).otherwise(0)).over(so_far))
    gap = Window.partitionBy("journey_id", "_n")
    for c in ("distance_m", "duration_s"):
        if c not in legs.columns:
            trains = trains.withColumn(c, F.lit(None).cast("double"))
    walked = trains.withColumn(
        "assumed_m", F.coalesce(F.sum(F.when(~train, F.col("distance_m"))).over(gap), F.lit(0)).cast("double")
    ).withColumn(
        "assumed_s", F.coalesce(F.sum(F.when(~train, F.col("duration_s"))).over(gap), F.lit(0)).cast("double"))
    own = [f"dep_{c}" for c in ("platform", "lat", "lon", "time", "late") if f"dep_{c}" in legs.columns]
    carried = [c for c in ("line", "cancelled", "leg_no") if c in legs.columns]
    after = F.lead(F.struct(*own, *carried)).over(order)
    arrive = [f"arr_{c}" for c in ("platform", "lat", "lon", "time", "late") if f"arr_{c}" in legs.columns]
    pairs = walked.where(train).withColumn("_next", after).where("_next is not null")
    return pairs.select(
        "journey_id", F.col("_n").cast("int").alias("change_no"), *[F.col(c) for c in arrive],
        *[F.col(f"_next.{c}").alias(c) for c in own],
        *[F.col(c).alias(f"arr_{c}") for c in carried], *[F.col(f"_next.{c}").alias(f"dep_{c}") for c in carried],
        "assumed_m", "assumed_s")


def with_times(changes: DataFrame) -> DataFrame:
    """Adds ``layover_s``, null when either time cannot be read."""
    return changes.withColumn("layover_s", layover(F.col("arr_time"), F.col("dep_time")))


def change_key() -> Column:
    """What a change's walk depends on: labels and coordinates to about 0.1 m, never the clock."""
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("-"))

    return F.concat_ws("|", *[text(F.round(c, 6)) for c in ("arr_lat", "arr_lon")], text(F.col("arr_platform")),
                       *[text(F.round(c, 6)) for c in ("dep_lat", "dep_lon")], text(F.col("dep_platform")))


def distinct_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes with their key, and one row per key: its walk is computed once for all journeys."""
    keyed = changes.withColumn("change_key", change_key())
    inputs = ["arr_lat", "arr_lon", "arr_platform", "dep_lat", "dep_lon", "dep_platform"]
    return keyed, keyed.select("change_key", *inputs).dropDuplicates(["change_key"])


def guard(changes: DataFrame) -> DataFrame:
    """Refs, gap and the first reason that rules out routing, if any."""
    refs = changes.withColumn("arr_ref", track_ref(F.col("arr_platform"))).withColumn(
        "dep_ref", track_ref(F.col("dep_platform")))
    gap = haversine("arr_lat", "arr_lon", "dep_lat", "dep_lon")
    no_coord = F.col("arr_lat").isNull() | F.col("arr_lon").isNull() | F.col("dep_lat").isNull() | F.col("dep_lon").isNull()
    return refs.withColumn("gap_m", gap).withColumn(
        "ruled_out",
        F.when(F.col("arr_ref").isNull() | F.col("dep_ref").isNull(), F.lit(M.NO_PLATFORM_DATA))
        .when(no_coord, F.lit(M.STATION_UNRESOLVED))
        .when(F.col("gap_m") > M.SAME_STATION_M, F.lit(M.CROSS_STATION)))


def implausible(metres: Column, gap_m: Column) -> Column:
    """A walk far longer than the platforms are apart: the label matched the wrong feature."""
    bound = F.greatest(F.lit(M.IMPLAUSIBLE_ABS_M), gap_m * M.IMPLAUSIBLE_DETOUR + M.IMPLAUSIBLE_SLACK_M)
    return F.coalesce(metres > bound, F.lit(False))


def resolve_walks(guarded: DataFrame, candidates: DataFrame, walks: DataFrame) -> DataFrame:
    """One walk or reason per change.

    guarded:    one row per ``change_key`` from ``guard``
    candidates: ``change_key, relation_id, name, rank`` (nearest first)
    walks:      ``change_key, relation_id, found, seconds, metres, reason`` and the ``*_by_coord`` flags

    The first candidate with a plausible walk wins; otherwise the nearest station is named and
    the reason is a rejected walk if there was one, else the first candidate's reason.
    """
    tried = candidates.join(walks, ["change_key", "relation_id"], "left").join(
        guarded.select("change_key", "gap_m"), "change_key")
    bogus = F.coalesce("found", F.lit(False)) & implausible(F.col("metres"), F.col("gap_m"))
    good = F.coalesce("found", F.lit(False)) & ~bogus
    row = F.struct("relation_id", "name", "seconds", "metres", "source_by_coord", "target_by_coord")
    picked = tried.groupBy("change_key").agg(
        F.min_by(row, F.when(good, F.col("rank"))).alias("w"),
        F.bool_or(bogus).alias("saw_bogus"),
        F.min_by("reason", F.when(~F.coalesce("found", F.lit(False)) & F.col("reason").isNotNull(), F.col("rank"))).alias("first_reason"),
        F.min_by(F.struct("relation_id", "name"), "rank").alias("near"),
        F.max(good).alias("routed"))
    out = guarded.join(picked, "change_key", "left")
    routed = F.col("ruled_out").isNull() & F.coalesce("routed", F.lit(False))
    return out.select(
        "change_key", "arr_ref", "dep_ref", "gap_m",
        F.when(routed, F.col("w.seconds")).alias("walk_s"), F.when(routed, F.col("w.metres")).alias("walk_m"),
        F.when(routed, F.col("w.relation_id")).when(
            F.col("ruled_out").isNull() | (F.col("ruled_out") == M.CROSS_STATION), F.col("near.relation_id")).alias("relation_id"),
        F.when(routed, F.col("w.name")).when(
            F.col("ruled_out").isNull() | (F.col("ruled_out") == M.CROSS_STATION), F.col("near.name")).alias("station"),
        F.when(routed, F.lit(None).cast("string"))
        .when(F.col("ruled_out").isNotNull(), F.col("ruled_out"))
        .when(F.col("near").isNull(), F.lit(M.STATION_UNRESOLVED))
        .when(F.coalesce("saw_bogus", F.lit(False)), F.lit(M.IMPLAUSIBLE_WALK))
        .otherwise(F.coalesce("first_reason", F.lit(M.PLATFORM_NOT_FOUND))).alias("reason"),
        F.when(routed, F.col("w.source_by_coord")).otherwise(F.lit(False)).alias("source_by_coord"),
        F.when(routed, F.col("w.target_by_coord")).otherwise(F.lit(False)).alias("target_by_coord"))


def classify(walk_s: Column, layover_s: Column, buffer_s: float = M.BUFFER_S) -> Column:
    return (
        F.when(walk_s.isNull() | layover_s.isNull(), F.lit(M.UNKNOWN))
        .when(layover_s < walk_s, F.lit(M.INFEASIBLE))
        .when(layover_s < walk_s + buffer_s, F.lit(M.TIGHT))
        .otherwise(F.lit(M.FEASIBLE)))


def verdicts(resolved: DataFrame, buffer_s: float = M.BUFFER_S) -> DataFrame:
    """Adds ``verdict``; a known walk without a readable layover is ``no_timing``."""
    verdict = classify(F.col("walk_s"), F.col("layover_s"), buffer_s)
    return resolved.withColumn("verdict", verdict).withColumn(
        "reason", F.when(F.col("walk_s").isNull(), F.col("reason")).when(
            F.col("verdict") == M.UNKNOWN, F.lit(M.NO_TIMING)))


VERDICT_RANK = {M.PENDING: -1, M.INFEASIBLE: 0, M.UNKNOWN: 1, M.TIGHT: 2, M.FEASIBLE: 3}


def journey_verdicts(journeys: DataFrame, transfers: DataFrame) -> DataFrame:
    """The worst verdict of each journey; one without changes cannot miss a train."""
    rank = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in VERDICT_RANK.items() for x in kv]), F.col("verdict")), F.lit(VERDICT_RANK[M.UNKNOWN]))
    worst = transfers.groupBy("journey_id").agg(
        F.min_by("verdict", rank).alias("verdict"), F.count(F.lit(1)).alias("n_changes"))
    return journeys.select("journey_id").distinct().join(worst, "journey_id", "left").select(
        "journey_id", F.coalesce("verdict", F.lit(M.FEASIBLE)).alias("verdict"),
        F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


def pending(changes: DataFrame) -> DataFrame:
    """Changes ready to show before any walk is known."""
    return with_times(changes).select(
        "journey_id", "change_no", track_ref(F.col("arr_platform")).alias("arr_ref"),
        track_ref(F.col("dep_platform")).alias("dep_ref"), "layover_s",
        F.lit(M.PENDING).alias("verdict"), F.lit(None).cast("string").alias("reason"))


def reconcile_label(map_label: Column, operator_label: Column, feed_ref: Column) -> Column:
    """The platform sign to show: the map's track if part of the operator's compound, else the
    operator's; nothing when it equals the feed's own label."""
    parts = F.transform(F.split(operator_label, "/"), lambda p: F.trim(p))
    chosen = (
        F.when(operator_label.isNull(), map_label)
        .when(map_label.isNotNull() & F.array_contains(parts, map_label), map_label)
        .otherwise(operator_label))
    return F.when((chosen != "") & ~chosen.eqNullSafe(feed_ref), chosen)


def recover_labels(ends: DataFrame) -> DataFrame:
    """``map_label, operator_label, feed_ref, by_coord`` to the ``actual`` label of one end."""
    return ends.withColumn("actual", F.when(
        F.col("by_coord"), reconcile_label(F.col("map_label"), F.col("operator_label"), F.col("feed_ref"))))


def live_score(buffer_s: float = M.BUFFER_S) -> dict[str, Column]:
    """Re-scoring columns over ``walk_s, layover_s, assumed_s, inbound_s, outbound_s``."""
    eff = F.col("layover_s") - F.coalesce("inbound_s", F.lit(0.0)) + F.coalesce("outbound_s", F.lit(0.0))
    known = F.col("walk_s").isNotNull() & F.col("layover_s").isNotNull()
    verdict = F.when(known, classify(F.col("walk_s"), eff, buffer_s)).otherwise(F.lit(M.UNKNOWN))
    return {
        "verdict": verdict,
        "effective_s": F.when(known, eff),
        "margin_s": F.when(known, eff - F.col("walk_s")),
        "absorb_s": F.when(known, eff - F.col("walk_s") - buffer_s),
        "rescued": known & F.coalesce(eff < F.col("assumed_s"), F.lit(False)) & verdict.isin(M.FEASIBLE, M.TIGHT),
    }


def latest_updates(updates: DataFrame) -> DataFrame:
    """The newest update per change of train."""
    keys = ["journey_id", "change_no"]
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("u")).select(*keys, "u.*")


def reassess(transfers: DataFrame, updates: DataFrame, buffer_s: float = M.BUFFER_S) -> DataFrame:
    """Every transfer re-scored against its update; no update means on time.

    A cancelled flag rides along but does not change the verdict.
    """
    live = updates.select("journey_id", "change_no", "inbound_s", "outbound_s", "cancelled")
    out = transfers.drop("inbound_s", "outbound_s", "cancelled").join(live, ["journey_id", "change_no"], "left")
    return out.withColumns(live_score(buffer_s)).withColumn("cancelled", F.coalesce("cancelled", F.lit(False)))


def retrack(transfers: DataFrame, updates: DataFrame, walks: DataFrame) -> DataFrame:
    """Transfers with the walk of their current platforms.

    An update naming another platform takes the walk of the new pair from ``walks``
    (``relation_id, arr_ref, dep_ref, seconds``) when there is one; otherwise nothing changes.
    """
    now = updates.select(
        "journey_id", "change_no", track_ref(F.col("arr_track_now")).alias("arr_now"),
        track_ref(F.col("dep_track_now")).alias("dep_now"))
    both = transfers.join(now, ["journey_id", "change_no"], "left").withColumn(
        "changed", F.coalesce(F.col("arr_now") != F.col("arr_ref"), F.lit(False))
        | F.coalesce(F.col("dep_now") != F.col("dep_ref"), F.lit(False)))
    changed = both.where("changed and relation_id is not null").select(
        "journey_id", "change_no", "relation_id",
        F.coalesce("arr_now", "arr_ref").alias("new_arr"), F.coalesce("dep_now", "dep_ref").alias("new_dep"))
    fresh = changed.join(walks.select(
        "relation_id", F.col("arr_ref").alias("new_arr"), F.col("dep_ref").alias("new_dep"), F.col("seconds").alias("new_s")),
        ["relation_id", "new_arr", "new_dep"]).drop("relation_id")
    out = both.drop("arr_now", "dep_now", "changed").join(fresh, ["journey_id", "change_no"], "left")
    hit = F.col("new_s").isNotNull()
    return out.withColumn("replanned", hit).withColumn("walk_s", F.coalesce("new_s", "walk_s")).withColumn(
        "arr_ref", F.when(hit, F.col("new_arr")).otherwise(F.col("arr_ref"))).withColumn(
        "dep_ref", F.when(hit, F.col("new_dep")).otherwise(F.col("dep_ref"))).drop("new_s", "new_arr", "new_dep")
