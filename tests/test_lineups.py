import random

import pytest
from conftest import box_row, play

from courtlake.operators import lineups as L


def tracked(make, plays, box_rows, block=4096):
    box = make.box(box_rows)
    tagged = L.tag_segments(make.pbp(plays), box, block)
    return box, tagged, L.segment_lineups(tagged, box)


def test_substitution_order(make):
    plays = [play(1, "2FGM", "A0", "AAA"), play(2, "OUT", "A0", "AAA"), play(3, "IN", "A5", "AAA"), play(4, "TO", "B0", "BBB")]
    _, tagged, lu = tracked(make, plays, make.teams_box())
    rows = {r.true_numberofplay: r for r in L.lineup_events(tagged, lu).collect()}
    assert rows[1].home_lineup == ["A0", "A1", "A2", "A3", "A4"]
    assert rows[2].home_lineup == ["A1", "A2", "A3", "A4"]
    assert rows[3].home_lineup == rows[4].home_lineup == ["A1", "A2", "A3", "A4", "A5"]
    assert rows[4].away_lineup == ["B0", "B1", "B2", "B3", "B4"]


@pytest.mark.parametrize("block", [2, 4096])
def test_lineups_equal_a_fold(make, block):
    """Random, also inconsistent, substitutions against a set walked play by play."""
    rng = random.Random(3)
    plays = []
    for n in range(1, 80):
        side = rng.choice("AB")
        kind = rng.choice(["IN", "OUT", "2FGM", "D", "BP"])
        pid = None if kind == "BP" else f"{side}{rng.randrange(7)}"
        plays.append(play(n, kind, pid, None if kind == "BP" else side * 3))
    _, tagged, lu = tracked(make, plays, make.teams_box(), block)
    got = {r.true_numberofplay: (r.home_lineup, r.away_lineup) for r in L.lineup_events(tagged, lu).collect()}
    court = {"AAA": {f"A{i}" for i in range(5)}, "BBB": {f"B{i}" for i in range(5)}}
    for p in plays:
        if p[3] == "IN":
            court[p[6]].add(p[4])
        elif p[3] == "OUT":
            court[p[6]].discard(p[4])
        assert got[p[10]] == (sorted(court["AAA"]), sorted(court["BBB"]))


def test_on_off_without_substitutions(make):
    plays = [play(1, "2FGM", "A0", "AAA"), play(2, "3FGM", "B0", "BBB"), play(3, "3FGM", "A1", "AAA"), play(4, "TO", "B1", "BBB"),
             play(5, "AG", "A2", "AAA"), play(6, "AS", "A0", "AAA")]
    box, tagged, lu = tracked(make, plays, make.teams_box(roster=5))
    r = L.on_off_splits(L.segment_totals(tagged, lu), box).filter("player_id = 'A0'").first()
    assert (r.on_events, r.on_pts_for, r.on_pts_against, r.on_poss) == (6, 5, 3, 2.0)
    assert (r.on_ortg, r.on_drtg, r.on_net_rtg, r.off_net_rtg, r.on_off_diff) == (250, 150, 100, 0, 100)


def test_transfer_gives_two_season_rows(spark):
    cols = "season int, gamecode int, team string, player_id string, player_name string, " + ", ".join(
        f"{s}_{c} {t}" for s in ("on", "off") for c, t in (("events", "int"), ("pts_for", "int"), ("pts_against", "int"), ("poss", "double")))
    row = lambda g, team, pts: (2024, g, team, "PXXX", "X", 50, pts, 20, 15.0, 40, 10, 12, 12.0)
    out = L.season_on_off(spark.createDataFrame([row(1, "OLY", 30), row(2, "PAO", 35), row(3, "PAO", 35)], cols)).collect()
    assert {(r.team, r.games, r.on_pts_for, r.on_ortg) for r in out} == {("OLY", 1, 30, 200.0), ("PAO", 2, 70, 70 / 30 * 100)}


def test_combos_and_current_lineup(make):
    plays = [play(n, "2FGM", "A0", "AAA") for n in range(1, 7)] + [play(7, "OUT", "A0", "AAA"), play(8, "IN", "A5", "AAA")]
    box, tagged, lu = tracked(make, plays, make.teams_box())
    totals = L.segment_totals(tagged, lu)
    duo = {tuple(r.combo): r for r in L.combo_synergy(totals, 2).filter("team = 'AAA'").collect()}
    assert duo["A0", "A1"].events_together == 6 and duo["A0", "A1"].net_rtg_together == 1200.0
    assert ("A0", "A5") not in duo and ("A1", "A5") not in duo
    assert len(L.combo_synergy(totals, 3).filter("team = 'BBB'").collect()) == 10
    cur = L.current_lineups(totals).filter("team = 'AAA'").first()
    assert cur.lineup == ["A1", "A2", "A3", "A4", "A5"] and cur.events == 1 and cur.pts_for == 0
    best = L.lineup_stats(totals, L.player_names(box)).filter("team = 'AAA' AND pts_for > 0").first()
    assert best.events == 6 and best.lineup_str.startswith("A0 X., A1 X.")


def test_stint_over_a_period_break(make):
    """In at 5:00 of the first period without an OUT; acts again in the second period."""
    plays = [
        play(1, "OUT", "A0", "AAA", secs=300), play(2, "IN", "A5", "AAA", secs=300), play(3, "2FGM", "A5", "AAA", secs=200, a=2, b=0),
        *[play(3 + i, "D", p, "AAA", period=2, secs=500) for i, p in enumerate(["A1", "A2", "A3", "A4", "A5"], 1)],
        play(9, "3FGM", "B0", "BBB", period=2, secs=400, a=2, b=3),
    ]
    box = make.box(make.teams_box())
    got = {(r.player_id, r.period): (r.start_sec, r.end_sec, r.plus_minus) for r in L.player_stints(make.pbp(plays), box).filter("team = 'AAA'").collect()}
    assert got["A0", 1] == (0, 300, 0) and got["A5", 1] == (300, 600, 2) and got["A5", 2] == (600, 1200, -3)
    assert ("A0", 2) not in got
    summary = L.stint_summary(L.player_stints(make.pbp(plays), box)).filter("player_id = 'A5'").first()
    assert (summary.total_min, summary.stints, summary.total_pm) == (15.0, 2, -1)
