"""Tag maps as Column expressions: levels, refs, costs, way classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footbridge import model as M

# level tags: a number with an optional exponent, and the three accepted shapes
_ANY = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NO_DASH = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]\+?[0-9]+)?"
_LIST = rf"^;*\s*{_ANY}\s*(?:;+\s*{_ANY}\s*)*;+$|^;+\s*{_ANY}\s*$|^;*\s*{_ANY}\s*(?:;+\s*{_ANY}\s*)+$"
_RANGE = rf"^({_NO_DASH})\s*-\s*({_ANY})$"
_SINGLE = rf"^{_NO_DASH}$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def tag(tags: Column | str, key: str) -> Column:
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(key))


def has_tag(tags: Column | str, key: str) -> Column:
    return tag(tags, key).isNotNull()


def number(text: Column) -> Column:
    """A plain decimal number, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def parse_levels(raw: Column) -> Column:
    """Level tag to floors: ``;`` list, dash range, single; anything else is ground.

    A dash after the first character always means a range, so ``1e-3`` is no number here.
    """
    text = F.trim(raw)
    spread = F.regexp_replace(F.regexp_replace(text, _RANGE, "$1;$2"), r"^;+|;+$", "")
    return F.when(
        text.rlike(f"{_LIST}|{_RANGE}|{_SINGLE}"), F.split(spread, r"\s*;[;\s]*").try_cast("array<double>")
    ).otherwise(F.array(F.lit(0.0)))


def ref_tokens(value: Column) -> Column:
    """``3; 4`` is two tracks; ``Steig 1`` is one."""
    return F.coalesce(
        F.filter(F.split(value, r"\s*;\s*"), lambda t: t != ""), F.array().cast("array<string>")
    )


def natural_key(ref: Column) -> Column:
    """A string that sorts refs as people read them: ``2`` before ``10``, ``3a`` after ``3``."""
    chunks = F.regexp_extract_all(ref, F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(chunks, lambda c: F.when(
        c.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(c, 24, "0"))
    ).otherwise(F.concat(F.lit("1"), F.lower(c))))
    return F.array_join(keyed, "\u0001")


def is_conveying(tags) -> Column:
    return F.coalesce(tag(tags, "conveying").isin("yes", "forward", "backward"), F.lit(False))


def is_elevator(tags) -> Column:
    return F.coalesce(tag(tags, "highway") == "elevator", F.lit(False)) | F.coalesce(
        tag(tags, "railway") == "elevator", F.lit(False)
    )


def _is(tags, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def is_walkable(tags) -> Column:
    return ~tag(tags, "public_transport").eqNullSafe(F.lit("station"))


def is_platform_edge(tags) -> Column:
    return _is(tags, "railway", "platform_edge")


def is_platform_area(tags) -> Column:
    return _is(tags, "railway", "platform") | _is(tags, "public_transport", "platform")


def is_any_platform(tags) -> Column:
    return _is(tags, "railway", "platform", "platform_edge") | _is(tags, "public_transport", "platform")


def is_pedestrian(tags) -> Column:
    return _is(
        tags, "highway", "footway", "steps", "pedestrian", "path", "corridor", "platform", "elevator"
    ) | is_any_platform(tags)


def is_stitch_connector(tags) -> Column:
    return (
        _is(tags, "highway", "footway", "steps", "corridor", "pedestrian", "elevator")
        | _is(tags, "railway", "elevator")
        | has_tag(tags, "conveying")
    )


def is_vertical_connector(tags) -> Column:
    return _is(tags, "highway", "steps", "elevator") | _is(tags, "railway", "elevator") | is_conveying(tags)


def is_non_rail_platform(tags) -> Column:
    return (
        _is(tags, "tram", "yes") | _is(tags, "bus", "yes") | _is(tags, "trolleybus", "yes")
        | has_tag(tags, "highway")
    )


def speed(tags) -> Column:
    return (
        F.when(is_conveying(tags), F.lit(M.ESCALATOR_SPEED))
        .when(_is(tags, "highway", "steps"), F.lit(M.STEPS_SPEED))
        .when(is_elevator(tags), F.lit(M.ELEVATOR_SPEED))
        .otherwise(F.lit(M.WALK_SPEED))
    )


def penalty(tags) -> Column:
    """Fixed seconds charged on every segment of the way."""
    return F.when(
        ~is_conveying(tags) & ~_is(tags, "highway", "steps") & is_elevator(tags),
        F.lit(M.ELEVATOR_WAIT_S),
    ).otherwise(F.lit(0.0))


def direction(tags) -> Column:
    """1 with the node order only, -1 against it only, 0 both ways."""
    return (
        F.when(_is(tags, "conveying", "forward"), F.lit(1))
        .when(_is(tags, "conveying", "backward"), F.lit(-1))
        .when(_is(tags, "oneway", "yes", "1", "true"), F.lit(1))
        .when(_is(tags, "oneway", "-1"), F.lit(-1))
        .otherwise(F.lit(0))
    )


def mechanism(tags) -> Column:
    """What a node changes floors with; null for an ordinary node."""
    return (
        F.when(is_elevator(tags), F.lit("elevator"))
        .when(is_conveying(tags), F.lit("escalator"))
        .when(_is(tags, "highway", "steps"), F.lit("stairs"))
    )


def climb_seconds(kind: Column, floors: Column) -> Column:
    rise = F.abs(floors) * F.lit(M.FLOOR_HEIGHT_M)
    return (
        F.when(kind == "elevator", F.lit(M.ELEVATOR_WAIT_S) + rise / F.lit(M.ELEVATOR_SPEED))
        .when(kind == "escalator", rise / F.lit(M.ESCALATOR_SPEED))
        .otherwise(rise / F.lit(M.STEPS_SPEED))
    )


def way_kind(tags, levels: Column) -> Column:
    multi = F.size(levels) > 1
    return (
        F.when(is_conveying(tags), F.lit("escalator"))
        .when(is_elevator(tags), F.lit("elevator"))
        .when(_is(tags, "highway", "steps"), F.lit("stairs"))
        .when(_is(tags, "railway", "platform", "platform_edge"), F.lit("platform"))
        .when(_is(tags, "highway", "footway", "corridor", "pedestrian") & multi, F.lit("ramp"))
        .when(_is(tags, "highway", "footway", "corridor", "pedestrian"), F.lit("walkway"))
        .otherwise(F.coalesce(
            F.nullif(tag(tags, "highway"), F.lit("")), F.nullif(tag(tags, "railway"), F.lit("")), F.lit("other")
        ))
    )


def is_level_connector(tags, levels: Column) -> Column:
    return (F.size(levels) > 1) | is_vertical_connector(tags)


def is_area(tags, nodes: Column) -> Column:
    return (
        _is(tags, "area", "yes") | _is(tags, "indoor", "room", "area")
        | has_tag(tags, "building") | has_tag(tags, "building:part")
        | ((F.size(nodes) >= 4) & F.coalesce(F.element_at(nodes, 1) == F.element_at(nodes, -1), F.lit(False)))
    )
