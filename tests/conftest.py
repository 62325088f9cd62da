import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from courtlake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = str(tmp_path_factory.mktemp("shared"))
    session = build_session("local[8]", "courtlake-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": scratch, "spark.sql.warehouse.dir": scratch + "/warehouse",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PBP = (
    "season int, gamecode int, period int, playtype string, player_id string, player string, codeteam string, "
    "markertime string, clock_secs int, numberofplay int, true_numberofplay int, points_a int, points_b int, comment string"
)
BOX_STATS = (
    "points fgm2 fga2 fgm3 fga3 ftm fta off_rebounds def_rebounds total_rebounds assists steals turnovers "
    "blocks_favour blocks_against fouls_committed fouls_received plus_minus"
).split()
BOX = (
    "season int, gamecode int, player_id string, player_name string, team_code string, is_home int, is_starter int, "
    "is_playing int, dorsal string, minutes_str string, seconds int, minutes double, "
    + ", ".join(f"{c} int" for c in BOX_STATS) + ", valuation int"
)


def play(n, playtype, pid=None, team=None, period=1, secs=300, a=None, b=None, game=1, season=2024):
    mm = f"{secs // 60:02d}:{secs % 60:02d}"
    return (season, game, period, playtype, pid, pid, team, mm, secs, n, n, a, b, None)


def box_row(pid, team, home, starter=1, secs=600, game=1, season=2024, name=None, **stats):
    return (
        season, game, pid, name or f"{pid}, X", team, home, starter, 1, "4", f"{secs // 60:02d}:{secs % 60:02d}", secs,
        secs / 60.0, *[stats.get(c, 0) for c in BOX_STATS], 0,
    )


@pytest.fixture(scope="session")
def make(spark):
    class Make:
        def pbp(self, rows):
            return spark.createDataFrame(rows, PBP)

        def box(self, rows):
            return spark.createDataFrame(rows, BOX)

        def games(self, rows):
            """(season, gamecode, round, home, away, home_score, away_score, day text, played)"""
            from pyspark.sql import functions as F

            return spark.createDataFrame(
                rows, "season int, gamecode int, round int, home_team string, away_team string, home_score int, away_score int, game_date string, played boolean"
            ).withColumn("game_day", F.to_date("game_date"))

        def teams_box(self, game=1, season=2024, roster=7):
            return [
                box_row(f"{t}{i}", team, home, int(i < 5), game=game, season=season)
                for t, team, home in (("A", "AAA", 1), ("B", "BBB", 0)) for i in range(roster)
            ]

    return Make()
