"""Registered queries against their check SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# every module is represented; tools/check.py runs the whole list
SAMPLE = [
    "walk_edges", "relation_members_closure", "walk_one_to_three", "stitch_bridges", "platform_ladder", "isolated_recovery",
    "interchange_pairs", "station_search", "pair_classes", "facility_ranking", "level_transitions", "coach_spans", "edge_ownership", "plan_legs",
    "member_reload", "stop_file_platforms", "stop_place_file_quays", "coach_feeds_numbered", "actual_formations", "refreshed_updates",
    "result_files", "overlay_files", "attributed_transitions", "path_landmarks", "arc_points", "harvested_tracks",
]


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_check_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in want)
    assert got


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
