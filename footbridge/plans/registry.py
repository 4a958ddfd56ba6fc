"""The list of registered queries, each with its check SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footbridge.plans.world import World, oracle_text

QUERIES: dict[str, Callable[[World], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}
SHARED_VIEWS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(world) -> DataFrame`` under a name with its check SQL."""

    def add(fn: Callable[[World], DataFrame]):
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](World(spark, sf_dir))


def check_sql(name: str) -> str:
    return oracle_text(SQL[name], SHARED_VIEWS)


def hav(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    """Great-circle metres as SQL text."""
    return (
        f"(2*6371000.0e0*asin(sqrt(pow(sin(radians(({b_lat})-({a_lat}))/2),2)"
        f"+cos(radians({a_lat}))*cos(radians({b_lat}))*pow(sin(radians(({b_lon})-({a_lon}))/2),2))))"
    )
