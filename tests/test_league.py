import pytest
from pyspark.sql import functions as F

from courtlake.operators import league as T, ranking as O, windows as W


def fixture_games(make):
    return make.games([
        (2024, 1, 1, "AAA", "BBB", 80, 70, "2024-10-01", True), (2024, 2, 2, "BBB", "AAA", 70, 70, "2024-10-04", True),
        (2024, 3, 3, "AAA", "CCC", 90, 95, "2024-10-06", True), (2024, 4, 4, "CCC", "AAA", None, None, "2024-10-20", False),
    ])


def test_tie_is_neither_win_nor_loss(make):
    got = {r.team_code: (r.wins, r.losses) for r in T.current_standings(fixture_games(make)).collect()}
    assert got == {"AAA": (1, 1), "BBB": (0, 1), "CCC": (1, 0)}


def test_close_games(spark, make):
    teams = spark.createDataFrame([("AAA", "A")], "team_code string, team_name string")
    r = {x.team_code: x for x in T.close_games(fixture_games(make), teams).collect()}
    assert (r["AAA"].close_games_played, r["AAA"].close_wins, r["AAA"].close_win_pct) == (2, 0, 0.0)
    assert r["BBB"].team_name == "BBB" and r["AAA"].league_avg_close_win_pct == 25.0


def test_double_week_takes_neighbouring_days_only(make):
    pairs = {(r.team_code, r.gc1, r.gc2, r.day_gap) for r in T.double_week_pairs(fixture_games(make)).collect()}
    assert pairs == {("AAA", 1, 2, 3), ("AAA", 2, 3, 2), ("BBB", 1, 2, 3)}


def test_form_and_rest(make):
    games = fixture_games(make)
    form = {(r.gamecode, r.team_code): r.form for r in W.recent_form(games).collect()}
    assert form[1, "AAA"] == 0.0 and form[2, "AAA"] == 10.0 and form[3, "AAA"] == 5.0 and form[4, "AAA"] == pytest.approx(5 / 3)
    rest = {(r.gamecode, r.team_code): r.rest_days for r in W.rest_days(games).collect()}
    assert rest[1, "AAA"] == 7 and rest[2, "AAA"] == 3 and rest[4, "AAA"] == 14
    latest = {r.team_code: r.rest_days for r in W.rest_days_latest(games, F.to_date(F.lit("2024-10-10"))).collect()}
    assert latest == {"AAA": 4, "BBB": 6, "CCC": 4}


def test_form_excludes_the_same_round(make):
    games = make.games([(2024, 1, 1, "AAA", "BBB", 80, 70, "2024-10-01", True), (2024, 2, 1, "AAA", "CCC", 60, 70, "2024-10-02", True)])
    assert {r.form for r in W.recent_form(games).filter("team_code = 'AAA'").collect()} == {0.0}


def test_percentile_ties(spark):
    df = spark.createDataFrame([(2024, "a", 1.0), (2024, "b", 1.0), (2024, "c", 2.0)], "season int, team_code string, x double")
    got = {r.team_code: round(r.x_pctl, 6) for r in W.percentile_ranks(df, ["x"], inverted=()).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": 100.0}


def test_hot_streaks(spark):
    rows = [(2024, "AAA", "P", "P", g, 600, v) for g, v in enumerate([0, 0, 30, 30, 30, 0, 0, 0, 0, 0, 30, 30, 30], 1)]
    df = spark.createDataFrame(rows, "season int, team_code string, player_id string, player_name string, gamecode int, seconds int, total_pts_created int")
    form = W.player_form(df)
    hot = [r.game_num for r in form.filter("is_hot").collect()]
    spans = [(r.start_game, r.end_game) for r in W.hot_streaks(form).collect()]
    assert sorted(spans) == [(5, 7), (13, 13)] and sorted(hot) == [5, 6, 7, 13]


def test_insight_text(spark):
    monthly = spark.createDataFrame([(2024, "AAA"), (2023, "AAA")], "season int, team_code string")
    curve = spark.createDataFrame([("AAA", m, x) for m, x in zip(range(1, 9), [0.0, 0.0, 0.0, 0.0, -4.0, -4.0, 4.0, 4.0])], "team_code string, month_index int, x_net_rtg double")
    r = T.form_insights(monthly, curve).first()
    assert r.insight == "Over 2 season(s): late winter brings a slump of -4.0 points per 100 possessions, spring a surge of +4.0."
    flat = curve.withColumn("x_net_rtg", F.lit(1.5))
    assert "stays near its mean of +1.5" in T.form_insights(monthly, flat).first().insight


def test_top_n_and_concat(spark):
    df = spark.createDataFrame([(1, i) for i in range(6)], "k int, v int")
    assert sorted(r.v for r in O.top_n(df, ["k"], [F.desc("v")], 2).collect()) == [4, 5]
    ends = O.best_and_worst(df, ["k"], "v", ["v"], 1, 2)
    assert sorted((r.end, r.v) for r in ends.collect()) == [("best", 5), ("worst", 0), ("worst", 1)]
    other = spark.createDataFrame([(1, "x")], "k int, extra string")
    assert O.concat_frames(df, other).columns == ["k", "v", "extra"]
