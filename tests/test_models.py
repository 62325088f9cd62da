import itertools
import math
import random

import numpy as np
import pytest

from courtlake import config as C
from courtlake.operators import lineups as L, models as M, projection as P
from courtlake.plans.league import League


def test_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(2024, f"P{i:02d}", f"N{i}", "AAA", "Guard", *[rng.random() for _ in C.SIMILARITY_FEATURES]) for i in range(40)]
    df = spark.createDataFrame(rows, "season int, player_code string, player_name string, team_code string, position string, " + ", ".join(f"{c} double" for c in C.SIMILARITY_FEATURES))
    x = np.array([r[5:] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    sims = z @ z.T
    np.fill_diagonal(sims, -9)
    for tile in (8, 512):
        got = {(r.player_code, r.rank): (r.similar_code, r.similarity) for r in M.similar_players(df, top_n=3, tile=tile).collect()}
        assert len(got) == 120
        for i in range(40):
            for k, j in enumerate(np.argsort(-sims[i])[:3], 1):
                code, s = got[f"P{i:02d}", k]
                assert code == f"P{j:02d}" and s == pytest.approx(sims[i, j])


def test_lineup_tables_are_not_sent_through_the_driver(spark, tmp_path):
    """Tables of files that are small next to their rows: no step up to the candidates and their features broadcasts one."""
    lg = League(spark, "/root/testdata/sf0.001")
    totals = L.segment_totals(tagged := L.tag_segments(lg.pbp, lg.box), L.segment_lineups(tagged, lg.box))
    stats, players, keys = L.lineup_stats(totals), M.player_season_features(lg.adv), ["season", "team", "lineup"]
    cand = M.fifth_player_candidates(stats, players, lg.box)
    for df in (M.lineup_training_set(stats, players), M.lineup_features(cand.select(*keys).distinct(), players, keys)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_cluster_names_are_greedy_and_unique():
    c = np.zeros((5, 6))
    c[2] = [0.5, 0, 0, 0, 3, 3]
    names = M.name_clusters(c)
    assert names[2] == "Pace & Space" and len(set(names.values())) == 5 and sum(n.startswith("Cluster") for n in names.values()) == 1


def test_projection_adds_up_and_follows_ratings(spark, make):
    teams = ["AAA", "BBB", "CCC", "DDD"]
    pairs = [(h, a) for h in teams for a in teams if h != a]
    games = make.games([(2024, i, i, h, a, None, None, "2025-01-01", False) for i, (h, a) in enumerate(pairs, 1)]
                       + [(2023, 1, 1, "AAA", "BBB", 70, 80, "2024-01-01", True)])
    eff = spark.createDataFrame([(2024, t, r) for t, r in zip(teams, (20.0, 5.0, -5.0, -20.0))], "season int, team_code string, net_rtg double")
    df = P.project_standings(games, eff).persist()
    top = {r.team_code: r for r in df.filter("season = 2024").collect()}
    wins = [top[t].expected_wins for t in teams]
    assert wins == sorted(wins, reverse=True) and sum(wins) == pytest.approx(12) and [top[t].proj_rank for t in teams] == [1, 2, 3, 4]
    assert top["AAA"].expected_wins + top["AAA"].expected_losses == pytest.approx(6)
    for r in top.values():  # against the sum over all outcomes of the six games
        net = dict(zip(teams, (20.0, 5.0, -5.0, -20.0)))
        p = [1 / (1 + math.exp(-(net[h] - net[a] + 2.5) / 10)) if h == r.team_code else 1 - 1 / (1 + math.exp(-(net[h] - net[a] + 2.5) / 10)) for h, a in pairs if r.team_code in (h, a)]
        want = [0.0] * 7
        for outcome in itertools.product((0, 1), repeat=6):
            want[sum(outcome)] += math.prod(x if w else 1 - x for x, w in zip(p, outcome))
        assert r.distribution == pytest.approx(want)
        assert sum(k * x for k, x in enumerate(r.distribution)) == pytest.approx(r.expected_wins)
    done = {r.team_code: (r.current_wins, r.games_left, r.distribution, r.proj_rank) for r in df.filter("season = 2023").collect()}
    assert done == {"BBB": (1, 0, [1.0], 1), "AAA": (0, 0, [1.0], 2)}
    assert P.win_table(df).filter("season = 2024").count() == 28


def test_win_model_prefers_the_better_team(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        h, a = rng.uniform(-10, 10), rng.uniform(-10, 10)
        rows.append((2024, i, "A", "B", h, a, h - a, 1, 0.0, 0.0, 3, 3, int(h - a + rng.gauss(0, 3) > 0)))
    df = spark.createDataFrame(rows, "season int, gamecode int, home_team string, away_team string, " + ", ".join(
        f"{c} double" if i < 3 or "form" in c else f"{c} int" for i, c in enumerate(C.GAME_FEATURES)) + ", home_win int")
    assert M.train_win_model(df.limit(10)) is None
    model = M.load_model(M.save_model(M.train_win_model(df), str(tmp_path / "m")))
    got = M.predict_games(model, df).join(df.select("gamecode", "net_rtg_diff"), "gamecode")
    best, worst = got.orderBy("net_rtg_diff").tail(1)[0], got.orderBy("net_rtg_diff").first()
    assert best.home_win_prob > 0.8 and worst.home_win_prob < 0.2


def test_small_gbt_and_fifth_player(spark):
    rng = random.Random(2)
    players = spark.createDataFrame(
        [(2024, f"P{i}", f"P{i}", "AAA", 10, 20.0, *[rng.random() for _ in C.PLAYER_MODEL_FEATURES]) for i in range(8)],
        "season int, player_id string, player_name string, team_code string, games int, minutes_pg double, " + ", ".join(f"{c} double" for c in C.PLAYER_MODEL_FEATURES))
    lineups = spark.createDataFrame([(2024, "AAA", sorted(rng.sample([f"P{i}" for i in range(8)], 5)), 50, rng.uniform(-10, 10)) for _ in range(40)],
                                    "season int, team string, lineup array<string>, events int, net_rtg double").dropDuplicates(["lineup"])
    training = M.lineup_training_set(lineups, players)
    assert M.train_lineup_model(training, min_rows=1000) is None
    model = M.train_lineup_model(training, min_rows=5, trees=3)
    best = M.best_fifth_player(model, lineups, players).collect()
    assert best and all(len(r.core) == 4 and r.candidate not in r.core and r["rank"] == 1 for r in best)


def test_training_does_not_depend_on_the_layout_of_its_rows(spark):
    rng = random.Random(3)
    rows = [(2024, f"T{i:02d}", m, rng.random(), rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(12) for m in range(1, 9)]
    df = spark.createDataFrame(rows, "season int, team_code string, month_index int, home_game_ratio double, opp_strength_avg double, net_rtg double")
    shuffled = rng.sample(rows, len(rows))
    other = spark.createDataFrame(shuffled, df.schema).repartition(7)
    a, b = ({(r.team_code, r.month_index): r.x_net_rtg for r in M.predict_form(M.train_form_model(d, trees=5), df).collect()} for d in (df.coalesce(1), other))
    assert a == b and len(set(a.values())) > 1
    few, many = (M._training_rows(d, 1)[0] for d in (df.limit(3), df.unionByName(df.withColumn("season", df.season + 1))))
    assert few.rdd.getNumPartitions() == many.rdd.getNumPartitions() == M.TRAINING_TASKS


def test_too_few_rows_give_an_empty_result_of_the_same_columns(spark):
    from courtlake.plans import queries_models as Q

    class Season:
        sf_dir = "too few rows"

    Season.spark = spark
    assert Q._model(Season, "win-model", lambda: None) is None
    df = spark.createDataFrame([(2024, f"T{i:02d}", m, 0.5, float(i), float(m)) for i in range(6) for m in range(1, 9)],
                               "season int, team_code string, month_index int, home_game_ratio double, opp_strength_avg double, net_rtg double")
    assert M.train_form_model(df.limit(5)) is None
    model = M.train_form_model(df, trees=2)
    none, some = M.predict_form(None, df), M.predict_form(model, df)
    assert none.collect() == [] and none.dtypes == some.dtypes and some.count() == 48


def test_too_few_teams_form_no_clusters(spark):
    factors = spark.createDataFrame([(2024, "A", *[0.5] * len(C.FOUR_FACTORS))] * 3, "season int, team_code string, " + ", ".join(f"{c} double" for c in C.FOUR_FACTORS))
    scored, km, pca = M.cluster_teams(factors, k=4)
    assert scored.collect() == [] and {"cluster_id", "cluster_name", "pc1", "pc2"} <= set(scored.columns) and km is None and pca is None
    assert M.style_profiles(factors).collect() == []
