"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``load`` is the ETL of the cleaned feeds. Every other time is one query from
loaded tables to its last row, with cached data dropped before it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from courtlake.plans import registry
from courtlake.plans.league import League
from courtlake.session import build_session

HEADLINE = [
    "b2_advanced_stats", "b4_season_player_stats", "t1_efficiency_landscape", "t4_home_away_splits", "t9_four_factors", "t11_monthly_form",
    "t14_double_week_fatigue", "t15_matchup_vulnerability", "t17_scouting_pool", "l1_lineup_tracking", "l2_lineup_stats", "l3_duo_synergy",
    "l4_player_stints", "l7_season_on_off", "l8_run_stoppers", "l12_win_probability", "c1_clutch_stats", "p2_assist_network",
    "p4_assist_shot_links", "p7_shot_quality", "w1_recent_form", "w3_player_form", "o1_leaderboards", "s16_seed_schedule",
    "s18_replace_games", "q3_boxscore_violations", "m8_lineup_radar", "m14_similar_players", "m16_standings_projection", "r2_live_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "courtlake-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    lg = League(spark, sf_dir)
    for table in ("box", "pbp", "shots", "schedule", "metadata", "extra", "teams", "players"):
        getattr(lg, table)
    times["load"] = time.perf_counter() - t0
    queries = registry.queries()
    for name in HEADLINE:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - t0
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {n: round(t, 3) for n, t in times.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
