"""Imports every module that registers queries."""

from importlib import import_module

MODULES = [
    "graph_queries",
    "spatial_queries",
    "journey_queries",
    "survey_queries",
    "height_queries",
    "boarding_queries",
    "feed_queries",
    "live_queries",
]


def load() -> None:
    for name in MODULES:
        import_module(f"footbridge.plans.{name}")
