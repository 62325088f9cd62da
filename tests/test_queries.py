"""Registered queries against their DuckDB statements on the smallest folder, and the plans they get."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from courtlake.plans.league import League

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "b2_advanced_stats", "b4_season_player_stats", "b9_positional_scoring", "t1_efficiency_landscape", "t7_close_games", "t11_monthly_form",
    "t15_matchup_vulnerability", "l1_lineup_tracking", "l3_duo_synergy", "l4_player_stints", "l7_season_on_off", "l8_run_stoppers", "c1_clutch_stats",
    "p4_assist_shot_links", "p7_shot_quality", "w1_recent_form", "w5_percentile_ranks", "o2_best_worst_lineups", "m8_lineup_radar", "m16_standings_projection",
    "s5_full_schedule", "s16_seed_schedule", "q5_shot_violations",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return float(v) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_statement(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    a = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = Counter(tuple(norm(r[cols.index(c)]) for c in order) for r in res.fetchall())
    assert a == b


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["t1_efficiency_landscape", "t6_referee_records", "t14_double_week_fatigue", "l3_trio_synergy", "l8_run_stoppers", "m14_similar_players"])
def test_no_nested_loop_or_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filtered(spark):
    from courtlake.operators import sequences as Q

    lg = League(spark, SF)
    text = plan(lg.pbp.filter("season = 2024").select("gamecode", "playtype").filter("playtype = 'AS'"))
    assert "ReadSchema: struct<season:int,gamecode:int,playtype:string>" in text and "EqualTo(playtype,AS)" in text
    assert "comment" not in plan(Q.live_score(lg.pbp)).split("ReadSchema")[1]


def test_play_log_is_shuffled_once_by_block(spark):
    """Without broadcasts the full play rows meet one exchange, keyed by game and block; join and window share it."""
    from courtlake.operators import lineups as L

    lg = League(spark, SF)
    spark.catalog.clearCache()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        text = plan(L.tag_segments(lg.pbp, lg.box))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    lines = text.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "comment" in line)
    above = [line for line in lines[:scan] if "Exchange hashpartitioning" in line]
    assert len(above) == 1 and "play_block" in above[0]
