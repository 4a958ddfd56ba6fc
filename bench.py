"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line."""

import json
import os
import time

from footbridge.plans import catalogue
from footbridge.plans.registry import QUERIES
from footbridge.plans.world import World
from footbridge.session import local_session

# the derived map and the walk table are built inside the first query that needs them
HEADLINE = [
    "way_segments", "walk_edges", "relation_members_closure", "platform_ladder", "nearest_node", "station_candidates",
    "stitch_bridges", "shortest_walks", "resolved_changes", "change_verdicts", "journey_verdicts", "delay_reassessment",
    "delay_sweep", "filled_platforms", "station_search", "facility_ranking", "coach_spans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load()
    world = World(spark, sf_dir)
    start = time.time()
    world.nodes, world.ways, world.members, world.relations, world.view("fx_legs")
    timings = {"load_world": round(time.time() - start, 3)}
    walks_per_s = None
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](World(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    n_changes = QUERIES["resolved_changes"](world).where("walk_s is not null").count()
    walks_per_s = round(n_changes / timings["resolved_changes"], 1)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")), "routed_changes": n_changes, "routed_changes_per_sec": walks_per_s,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
