from pyspark.sql import functions as F

from courtlake.operators import filters as FL, league as T
from courtlake.plans.bundle import clutch_bundle, full_bundle, team_season_bundle
from courtlake.plans.league import League
from courtlake.sources.store import Store
from courtlake.plans.season import sync_games
from courtlake.sources import sinks as W

SF = "/root/testdata/sf0.001"


def test_every_bundle_table_has_a_plan(spark):
    lg = League(spark, SF)
    for bundle in (full_bundle(lg), clutch_bundle(lg), team_season_bundle(lg, "OLY")):
        for name in bundle:
            assert bundle[name].columns, name
    assert len(full_bundle(lg)) == 13


def test_clutch_bundle_is_a_subset(spark):
    lg = League(spark, SF)
    whole = full_bundle(lg)["lineup_stats"].agg(F.sum("events")).first()[0]
    part = clutch_bundle(lg)["lineup_stats"].agg(F.sum("events")).first()[0]
    assert 0 < part < whole


def test_season_load_reports_and_fills_every_table(spark, tmp_path):
    lg = League(spark, SF)
    report = sync_games(spark, str(tmp_path), lg.box, lg.pbp, lg.shots, lg.schedule, lg.metadata, lg.teams, lg.players).collect()
    assert [(r.total, r.loaded, r.failed) for r in report] == [(10, 10, 0)]
    store = Store(spark, str(tmp_path))
    for name in ("teams", "players", "games", "boxscores", "play_by_play", "shots", "player_advanced_stats", "season_on_off_splits"):
        assert store.read(name).limit(1).count() == 1, name
    again = T.efficiency_landscape(store.read("player_advanced_stats"), store.read("games"), store.read("teams"))
    want = {r.team_code: round(r.net_rtg, 6) for r in lg.efficiency.collect()}
    assert {r.team_code: round(r.net_rtg, 6) for r in again.collect()} == want
    assert FL.has_officials(store.read("games")).first().has_referees


def test_second_season_keeps_the_first(spark, tmp_path, monkeypatch):
    """Rows of other seasons, teams and players stay; a load that fails leaves the tables as they were."""
    import pytest

    lg = League(spark, SF)
    shift = lambda df: df.withColumn("season", F.col("season") + 1)
    own = lambda df: df.withColumn("player_id", F.concat(F.lit("X"), "player_id"))
    root = str(tmp_path)
    sync_games(spark, root, lg.box, lg.pbp, lg.shots, lg.schedule, lg.metadata, lg.teams, lg.players)
    count = lambda: {n: Store(spark, root).read(n).count() for n in ("players", "games", "boxscores", "play_by_play", "shots", "season_on_off_splits")}
    one = count()
    second = (own(shift(lg.box)), own(shift(lg.pbp)), shift(lg.shots), shift(lg.schedule), shift(lg.metadata), lg.teams, None)
    with monkeypatch.context() as m:
        m.setattr("courtlake.plans.season.aggregate_seasons", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sync_games(spark, root, *second)
    assert count() == one
    report = sync_games(spark, root, *second).collect()
    assert [(r.total, r.loaded, r.failed) for r in report] == [(10, 10, 0)]
    assert count() == {n: 2 * c for n, c in one.items()}
    again = sync_games(spark, root, *second).collect()
    assert [(r.total, r.loaded, r.failed) for r in again] == [(10, 0, 0)] and count() == {n: 2 * c for n, c in one.items()}
