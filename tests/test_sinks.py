import pytest
from pyspark.sql import functions as F

from courtlake.operators import quality as Q
from courtlake.sources import feeds as S, sinks as W


def test_merge_rules(spark):
    stored = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", None, None)], "k string, v int, played boolean")
    updates = spark.createDataFrame([("a", None, False), ("b", 9, True), ("d", 4, None)], "k string, v int, played boolean")
    got = {r.k: (r.v, r.played, r.change) for r in W.merge(stored, updates, ["k"], {"played": W.ever_true}).collect()}
    assert got == {"a": (1, True, "updated"), "b": (9, True, "updated"), "c": (None, None, "kept"), "d": (4, None, "inserted")}
    patched = W.merge(stored, updates, ["k"], insert=False)
    assert "d" not in {r.k for r in patched.collect()}
    counts = W.merge_counts(W.merge(stored, updates, ["k"])).first()
    assert (counts.total, counts.inserted, counts.updated) == (3, 1, 2)


def test_team_names(spark):
    stored = spark.createDataFrame([("AAA", "AAA", None), ("BBB", "Club B", None)], "team_code string, team_name string, logo_url string")
    fresh = spark.createDataFrame([("AAA", "Club A", "u"), ("BBB", "BBB", None)], "team_code string, team_name string, logo_url string")
    got = {r.team_code: (r.team_name, r.logo_url) for r in W.load_teams_from_schedule(stored, fresh).collect()}
    assert got == {"AAA": ("Club A", "u"), "BBB": ("Club B", None)}


def test_replace_games(spark):
    old = spark.createDataFrame([(1, 1, "old"), (1, 2, "old")], "season int, gamecode int, v string")
    new = spark.createDataFrame([(1, 2, "new"), (1, 2, "new2")], "season int, gamecode int, v string")
    assert sorted((r.gamecode, r.v) for r in W.replace_games(old, new).collect()) == [(1, "old"), (2, "new"), (2, "new2")]


@pytest.mark.parametrize("fmt", ["json", "parquet", "csv"])
def test_landing_formats(spark, tmp_path, fmt):
    from courtlake import schemas

    raw = spark.createDataFrame(
        [(2024, 1, 1, "P1  ", 1, 1, "PAN", "4", "A, B", "10:30", *[0] * 18, 1.0), (2024, 1, 1, "Total", 0, 0, "PAN", "", "", "", *[0] * 18, 0.0)],
        schemas.RAW_BOXSCORE)
    path = str(tmp_path / f"box.{fmt}")
    raw.write.format(fmt).option("header", "true").save(path)
    rows = S.read_boxscores(spark, path).collect()
    assert [(r.player_id, r.team_code, r.seconds) for r in rows] == [("P1", "PAO", 630)]


def test_future_games_are_not_played(spark):
    cols = "season int, gamecode int, round int, round_name string, played boolean, home_code string, away_code string, home_score int, away_score int, game_day date"
    d = lambda t: __import__("datetime").date.fromisoformat(t)
    base = spark.createDataFrame([(2024, 1, 1, "RS", True, "A", "B", 80, 70, d("2024-10-01")), (2024, 2, 1, "PO", True, "A", "B", 80, 70, d("2024-10-01"))], cols)
    extra = spark.createDataFrame([(2024, 1, 36, "RS", True, "A", "B", 1, 2, d("2024-10-01")), (2024, 3, 36, "RS", True, "A", "B", 3, 4, d("2025-10-01")),
                                   (2024, 4, 39, "RS", False, "A", "B", None, None, d("2025-10-01"))], cols)
    got = {r.gamecode: (r.played, r.home_score) for r in S.full_schedule(base, extra, F.to_date(F.lit("2025-01-01"))).collect()}
    assert got == {1: (True, 80), 3: (False, None)}


def test_quality_rules(make):
    from conftest import box_row, play

    box = make.teams_box()
    assert Q.boxscore_violations(make.box(box)).count() == 0
    bad = box[:-1] + [box_row("B6", "BBB", 0, starter=1, fgm2=2, fga2=1, points=5)]
    rules = {(r.subject, r.rule) for r in Q.boxscore_violations(make.box(bad)).collect()}
    assert rules == {("B6", "fgm2>fga2"), ("B6", "points"), ("BBB", "five starters")}
    pbp = make.pbp([play(1, "XX", "A0", "AAA"), play(1, "IN", "A0", "AAA"), play(2, "IN", "A0", "AAA"), play(3, "IN", "A0", "AAA")])
    assert {r.rule for r in Q.play_by_play_violations(pbp).collect()} == {"four periods", "known plays", "play order", "substitutions"}
