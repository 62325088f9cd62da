from conftest import box_row, play

from courtlake.operators import clutch as K, playmaking as P, sequences as S


def test_run_of_eight_and_seven(make):
    run = [play(1, "2FGM", "A0", "AAA", a=2, b=0), play(2, "3FGM", "A1", "AAA", a=5, b=0), play(3, "TO", "B1", "BBB"),
           play(4, "3FGM", "A0", "AAA", a=8, b=0), play(5, "2FGM", "B2", "BBB", a=8, b=2)]
    short = [play(1, "2FGM", "A0", "AAA", game=2), play(2, "2FGM", "A0", "AAA", game=2), play(3, "3FGM", "A0", "AAA", game=2), play(4, "FTM", "B0", "BBB", game=2)]
    for block in (2, 4096):
        rows = S.run_stoppers(make.pbp(run + short), block=block).collect()
        assert [(r.gamecode, r.run_team, r.run_points, r.stopper_player_id, r.stop_play) for r in rows] == [(1, "AAA", 8, "B2", 5)]


def test_active_run_and_score(make):
    plays = [play(1, "2FGM", "A0", "AAA", secs=500, a=2, b=0), play(2, "3FGM", "B0", "BBB", secs=400, a=2, b=3),
             play(3, "2FGM", "B1", "BBB", secs=350, a=2, b=5), play(4, "TO", "A0", "AAA", secs=330)]
    r = S.active_run(make.pbp(plays)).first()
    assert (r.run_team, r.run_points, r.opponent_team, r.duration_secs, r.scoring_plays) == ("BBB", 5, "AAA", 50, "B0 (3FGM); B1 (2FGM)")
    s = S.live_score(make.pbp(plays)).first()
    assert (s.home_score, s.away_score, s.total_seconds_elapsed, s.total_seconds_remaining) == (2, 5, 270, 2130)


def test_foul_trouble_splits_long_logs(make):
    """A game over several blocks, both teams' stars in trouble, equals one block; plays without order count on neither side."""
    box = make.box([box_row("A0", "AAA", 1, fga2=20), box_row("B0", "BBB", 0, fga2=5)])
    plays = [play(n, "2FGM" if n % 2 else "3FGM", "A0" if n % 3 else "B0", "AAA" if n % 3 else "BBB") for n in range(10, 9000, 7)]
    plays += [play(n, "CM", p, t) for n, p, t in ((1, "A0", "AAA"), (5002, "A0", "AAA"), (2, "B0", "BBB"), (300, "B0", "BBB"))]
    plays += [(*x[:9], None, None, *x[11:]) for x in [play(0, "3FGM", "A0", "AAA")]]
    got = {r.team: r for r in S.foul_trouble_impact(make.pbp(plays), box).collect()}
    assert {t: r.second_foul_play_num for t, r in got.items()} == {"AAA": 5002, "BBB": 300}
    made = lambda team, keep: [2 if x[3] == "2FGM" else 3 for x in plays if x[6] == team and x[3] in ("2FGM", "3FGM") and x[10] is not None and keep(x[10])]
    for team, cut in (("AAA", 5002), ("BBB", 300)):
        for name, keep in (("before", lambda n: n < cut), ("after", lambda n: n >= cut)):
            own = made(team, keep)
            assert abs(got[team][f"ortg_{name}"] - sum(own) / len(own) * 100) < 1e-9


def test_foul_trouble_sends_no_log_through_the_driver(make, tmp_path):
    """Files are many times smaller than their rows: by their size Spark took the whole log for small."""
    stored = lambda df, name: (df.write.parquet(f"{tmp_path}/{name}"), df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}"))[1]
    pbp = stored(make.pbp([play(1, "CM", "A0", "AAA"), play(2, "CM", "A0", "AAA"), play(3, "2FGM", "A0", "AAA")]), "pbp")
    box = stored(make.box([box_row("A0", "AAA", 1, fga2=20), box_row("B0", "BBB", 0)]), "box")
    plan = S.foul_trouble_impact(pbp, box)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_foul_trouble_splits_at_second_foul(make):
    box = make.box([box_row("A0", "AAA", 1, fga2=20), box_row("A1", "AAA", 1), box_row("B0", "BBB", 0, fga2=5)])
    plays = [play(1, "2FGM", "A0", "AAA"), play(2, "CM", "A0", "AAA", period=2), play(3, "2FGA", "A1", "AAA", period=2),
             play(4, "CM", "A0", "AAA", period=2), play(5, "3FGM", "B0", "BBB", period=2), play(6, "TO", "A1", "AAA", period=2)]
    r = S.foul_trouble_impact(make.pbp(plays), box).collect()
    assert [(x.team, x.second_foul_play_num, x.ortg_before, x.ortg_after, x.drtg_after) for x in r] == [("AAA", 4, 100.0, 0.0, 300.0)]


def test_clutch_fill(make):
    plays = [play(1, "2FGM", "A0", "AAA", period=4, secs=290, a=80, b=60), play(2, "TO", "B0", "BBB", period=4, secs=280),
             play(3, "2FGM", "B0", "BBB", period=5, secs=200, a=80, b=78), play(4, "D", "A1", "AAA", period=5, secs=190)]
    pbp = make.pbp(plays)
    orders = lambda df: sorted(r.true_numberofplay for r in df.collect())
    assert orders(K.clutch_plays(pbp)) == [3, 4] == orders(K.clutch_plays(pbp, block=1))
    assert orders(K.clutch_plays(pbp, score_fill="zero")) == [2, 3, 4]
    stats = {r.player_id: r for r in K.clutch_stats(K.clutch_plays(pbp), make.box(make.teams_box())).collect()}
    assert stats["B0"].clutch_points == 2 and stats["B0"].clutch_usage == 1.0 and stats["A1"].clutch_ts_pct is None


def test_double_assist_and_broken_links(make):
    plays = [play(1, "2FGM", "A0", "AAA"), play(2, "AS", "A1", "AAA"), play(3, "AS", "A2", "AAA"), play(4, "2FGA", "A0", "AAA"), play(5, "AS", "A1", "AAA"),
             play(6, "2FGM", "A0", "AAA"), play(7, "AS", "B0", "BBB"), play(8, "3FGM", "B1", "BBB"), play(9, "RV", "B1", "BBB"), play(10, "AS", "B0", "BBB")]
    for block in (2, 4096):
        pairs = sorted((r.passer_id, r.shooter_id) for r in P.assist_pairs(make.pbp(plays), block).collect())
        assert pairs == [("A1", "A0"), ("A2", "A0")]


def _shots(spark, rows):
    return spark.createDataFrame(rows, "season int, gamecode int, num_anot int, id_player string, id_action string, points int, minute int, coord_x double, coord_y double, zone string, shot_value int, made int, player string, team string")


def test_each_shot_is_used_once(spark, make):
    shot = lambda n, minute, x, pid="A0": (2024, 1, n, pid, "2FGM", 2, minute, x, 72.0, "C", 2, 1, pid, "AAA")
    shots = _shots(spark, [shot(1, 5, 10.0), shot(2, 6, 20.0), shot(9, 5, 30.0, "A3")])
    plays = [play(1, "2FGM", "A0", "AAA", secs=310), play(2, "AS", "A1", "AAA", secs=310), play(3, "2FGM", "A0", "AAA", secs=300), play(4, "AS", "A1", "AAA", secs=300),
             play(5, "2FGM", "A3", "AAA", secs=290), play(6, "AS", "A1", "AAA", secs=290), play(7, "3FGM", "A4", "AAA", secs=280), play(8, "AS", "A1", "AAA", secs=280)]
    links = {r.assist_play: r for r in P.link_assists_to_shots(P.assist_pairs(make.pbp(plays)), shots).collect()}
    assert (links[2].num_anot, links[4].num_anot, links[6].num_anot, links[8].num_anot) == (1, 2, 9, None)
    assert links[2].xp == 1.3 and round(links[8].xp, 9) == 1.05 and links[8].coord_x is None


def test_shot_quality_sums_to_zone_means(spark):
    rows = [(2024, 1, i, "P", "2FGM" if i % 2 else "2FGA", 2 if i % 2 else 0, 1, 0.0, 0.0, "A", 2, i % 2, "P", "AAA") for i in range(4)]
    r = P.shot_quality(_shots(spark, rows)).first()
    assert (r.total_shots, r.makes, r.avg_expected_pts, r.shot_quality_diff) == (4, 2, 1.0, 0.0)


def test_shots_are_taken_one_by_one_in_the_jvm(spark, make):
    """Against a loop over random groups with ties in time; no Python worker in the plan."""
    import random

    rng = random.Random(4)
    pairs, shots, want = [], [], {}
    for g in range(30):
        free = sorted((n, float(rng.randrange(1, 6))) for n in rng.sample(range(100), rng.randrange(0, 6)))
        shots += [(2024, g, n, "P1", "2FGM", 2, m, float(n), 1.0, "A") for n, m in free]
        for k in sorted(rng.sample(range(200, 300), rng.randrange(1, 6))):
            minute = rng.randrange(1, 6)
            pairs.append((2024, g, k, "Q", "Q", "P1", "P1", "AAA", 2, "2FGM", 1, 600 - 60 * minute, k))
            best = min(free, key=lambda s: (abs(s[1] - minute), s[0]), default=None)
            want[g, k] = best and best[0]
            free = [s for s in free if s != best]
    links = P.link_assists_to_shots(
        spark.createDataFrame(pairs, "season int, gamecode int, assist_play int, passer_id string, passer_name string, shooter_id string, shooter_name string, team string, shot_value int, play_type string, period int, clock_secs int, numberofplay int"),
        spark.createDataFrame(shots, "season int, gamecode int, num_anot int, id_player string, id_action string, points int, minute double, coord_x double, coord_y double, zone string"))
    assert {(r.gamecode, r.assist_play): r.num_anot for r in links.collect()} == want
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "Join" not in plan
