import pytest
from conftest import box_row

from courtlake.operators import box as B


def test_exact_arithmetic(make):
    rows = [
        box_row("P1", "HOM", 1, secs=1800, points=25, fgm2=5, fga2=10, fgm3=3, fga3=6, ftm=6, fta=8, off_rebounds=1, def_rebounds=3,
                total_rebounds=4, assists=8, steals=2, turnovers=3, fouls_received=6),
        box_row("P2", "HOM", 1, secs=600, points=4, fgm2=2, fga2=2, off_rebounds=2, def_rebounds=4, total_rebounds=6, turnovers=1,
                blocks_favour=2, fouls_received=1),
    ]
    p1 = B.advanced_stats(make.box(rows)).filter("player_id = 'P1'").first()
    assert p1.possessions == pytest.approx(16.89, abs=0.01)
    assert p1.ts_pct == pytest.approx(0.64036, abs=0.001)
    assert p1.off_rating == pytest.approx(148.016, abs=0.01)
    assert p1.def_rating is None


def test_two_team_ratings_and_idle_player(make):
    line = dict(fga2=8, fta=2, off_rebounds=1, turnovers=1, points=10)
    rows = [box_row(f"H{i}", "OLY", 1, **line) for i in range(5)]
    rows += [box_row(f"G{i}", "PAO", 0, fga2=8, fta=3, off_rebounds=1, turnovers=2, points=12) for i in range(5)]
    rows.append(box_row("H9", "OLY", 1, 0, secs=0))
    adv = {r.player_id: r for r in B.advanced_stats(make.box(rows)).collect()}
    assert adv["H0"].possessions == pytest.approx(44.4 / 5)
    assert adv["H0"].def_rating == pytest.approx(60 / 44.4 * 100)
    assert adv["G0"].def_rating == pytest.approx(50 / 51.6 * 100)
    assert adv["H9"].possessions == 0 and adv["H9"].ts_pct is None and adv["H9"].off_rating is None


def test_positions_and_shares(make):
    rows = [
        box_row("g1", "AAA", 1, assists=9, total_rebounds=1, points=10), box_row("g2", "AAA", 1, assists=7, total_rebounds=1, points=5),
        box_row("c1", "AAA", 1, assists=0, total_rebounds=9, points=5), box_row("f1", "AAA", 1, assists=1, total_rebounds=3),
        box_row("x1", "BBB", 0, points=4), box_row("x2", "BBB", 0, points=4),
    ]
    got = {r.player_id: r.position for r in B.classify_positions(make.box(rows)).collect()}
    assert got == {"g1": "Guard", "g2": "Guard", "c1": "Center", "f1": "Forward", "x1": "Forward", "x2": "Forward"}
    pct = {(r.team_code, r.position): r.pct for r in B.positional_scoring(make.box(rows)).collect()}
    assert pct["AAA", "Guard"] == 75 and pct["AAA", "Center"] == 25 and pct["AAA", "Forward"] == 0
    assert pct["BBB", "Forward"] == 100 and pct["BBB", "Guard"] == 0


def test_season_stats_drop_idle_players(make):
    rows = [box_row("P1", "AAA", 1, game=g, points=10, fga2=8) for g in (1, 2)] + [box_row("P2", "AAA", 1, secs=0)]
    got = B.season_player_stats(B.advanced_stats(make.box(rows))).collect()
    assert [(r.player_id, r.points, r.ts_pct) for r in got] == [("P1", 20, 20 / 32)]
