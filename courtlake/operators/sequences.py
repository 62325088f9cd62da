"""Scoring runs, foul trouble, momentum and the live clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X
from courtlake.functions.scans import BLOCK, join_per_key, running
from courtlake.operators.lineups import game_sides

_G = C.GAME_KEYS


def scoring_runs(pbp: DataFrame, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Uninterrupted scoring by one team.

    A team's run is identified by how many baskets the others had made before
    it, so one running count replaces the usual change-flag-then-sum pair.
    """
    scored = pbp.filter(X.points_of("playtype") > 0).filter(F.col("codeteam").isNotNull())
    first = scored.groupBy(*_G).agg(F.min("codeteam").alias("team_one"))
    own = F.when(F.col("codeteam") == F.col("team_one"), 1).otherwise(0)
    counted = running(
        join_per_key(scored, first, _G, C.PLAY_ORDER, block), _G, C.PLAY_ORDER,
        sums={"one_n": own, "two_n": 1 - own}, block=F.col(BLOCK),
    ).drop(BLOCK)
    one = F.col("codeteam") == F.col("team_one")
    return counted.withColumns(
        {
            "own_n": F.when(one, F.col("one_n")).otherwise(F.col("two_n")),
            "opp_n": F.when(one, F.col("two_n")).otherwise(F.col("one_n")),
        }
    ).drop("one_n", "two_n", "team_one")


def run_stoppers(pbp: DataFrame, min_run: int = 8, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Runs of at least ``min_run`` unanswered points and the first opposing scorer after each."""
    scored = scoring_runs(pbp, block)
    runs = scored.groupBy(*_G, "codeteam", "opp_n").agg(F.sum(X.points_of("playtype")).alias("run_points")).filter(
        F.col("run_points") >= min_run
    )
    stop = scored.select(
        *_G, F.col("codeteam").alias("stopper_team"), F.col("own_n").alias("stop_n"),
        F.col("player").alias("stopper_player"), F.col("player_id").alias("stopper_player_id"),
        F.col("playtype").alias("stopper_playtype"), "period", "markertime", F.col(C.PLAY_ORDER).alias("stop_play"),
    )
    return (
        runs.withColumnRenamed("codeteam", "run_team")
        .withColumn("stop_n", F.col("opp_n") + 1)
        .join(stop, [*_G, "stop_n"])
        .filter(F.col("stopper_team") != F.col("run_team"))
        .drop("stop_n", "opp_n")
    )


def active_run(pbp: DataFrame, min_points: int = 4) -> DataFrame:
    """The run in progress at the end of each game's log, found by aggregates alone."""
    scored = pbp.filter(
        (X.points_of("playtype") > 0) & F.col("points_a").isNotNull() & F.col("points_b").isNotNull()
    )
    last = scored.groupBy(*_G).agg(F.max_by("codeteam", C.PLAY_ORDER).alias("run_team"))
    broken = (
        scored.join(last, _G).filter(F.col("codeteam") != F.col("run_team"))
        .groupBy(*_G).agg(F.max(C.PLAY_ORDER).alias("broken_at"))
    )
    teams = pbp.filter(F.col("codeteam").isNotNull()).select(*_G, "codeteam").distinct()
    opponent = teams.join(last, _G).filter(F.col("codeteam") != F.col("run_team")).groupBy(*_G).agg(
        F.min("codeteam").alias("opponent_team")
    )
    run = (
        scored.join(last, _G).join(broken, _G, "left")
        .filter(F.col(C.PLAY_ORDER) > F.coalesce("broken_at", F.lit(-1)))
        .groupBy(*_G, "run_team")
        .agg(
            F.sum(X.points_of("playtype")).alias("run_points"),
            F.abs(F.min_by("clock_secs", C.PLAY_ORDER) - F.max_by("clock_secs", C.PLAY_ORDER)).alias("duration_secs"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(
                        F.col(C.PLAY_ORDER).alias("n"),
                        F.concat(F.coalesce("player", F.lit("Unknown")), F.lit(" ("), F.col("playtype"), F.lit(")")).alias("play"),
                    ))),
                    lambda s: s["play"],
                ), "; ",
            ).alias("scoring_plays"),
        )
        .filter(F.col("run_points") >= min_points)
    )
    return run.join(opponent, _G, "left").withColumn("opponent_team", F.coalesce("opponent_team", F.lit("OPP")))


def foul_trouble_impact(pbp: DataFrame, box: DataFrame) -> DataFrame:
    """Team ratings before and after its busiest shooter's second first-half foul."""
    usage = F.col("fga2") + F.col("fga3") + F.col("fta")
    star = box.groupBy(*_G, F.col("team_code").alias("team")).agg(
        F.min(F.struct((-usage).alias("u"), "player_id", "player_name")).alias("s")
    ).select(*_G, "team", F.col("s.player_id").alias("star_player_id"), F.col("s.player_name").alias("star_player"))
    fouls = pbp.filter(F.col("playtype").isin(C.FOUL_PLAYS) & (F.col("period") <= 2)).select(
        *_G, F.col("player_id").alias("star_player_id"), C.PLAY_ORDER, "period"
    )
    nth = F.row_number().over(Window.partitionBy(*_G, "star_player_id").orderBy(C.PLAY_ORDER))
    second = (
        fouls.join(star.hint("merge"), [*_G, "star_player_id"])
        .withColumn("n", nth).filter(F.col("n") == 2).drop("n")
        .withColumnsRenamed({C.PLAY_ORDER: "second_foul_play_num", "period": "foul_period"})
    )
    sides = game_sides(box)
    opp = F.when(F.col("team") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    marks = second.join(sides.hint("merge"), _G).withColumn("opp", opp).drop("home_team", "away_team")
    pts, poss = X.points_of("playtype"), X.is_possession("playtype")
    before = F.col(C.PLAY_ORDER) < F.col("second_foul_play_num")
    own, other = F.col("codeteam") == F.col("team"), F.col("codeteam") == F.col("opp")
    cut = {"before": before, "after": ~before}
    aggs = []
    for name, cond in cut.items():
        aggs += [
            F.sum(F.when(cond & own, pts).otherwise(0)).alias(f"f_{name}"),
            F.sum(F.when(cond & other, pts).otherwise(0)).alias(f"a_{name}"),
            F.greatest(F.count_if(cond & own & poss), F.lit(1)).alias(f"p_{name}"),
        ]
    keys = [*_G, "team", "star_player_id", "star_player", "second_foul_play_num", "foul_period"]
    rate = lambda k, n: (F.col(f"{k}_{n}") / F.col(f"p_{n}") * 100)
    plays = pbp.select(*_G, C.PLAY_ORDER, F.coalesce(C.PLAY_ORDER, F.lit(0)).alias("at"), "codeteam", "playtype")  # a play without order stays
    df = join_per_key(plays, marks, _G, "at").groupBy(*keys).agg(*aggs).withColumns(
        {f"{r}_{n}": rate(k, n) for n in cut for r, k in (("ortg", "f"), ("drtg", "a"))}
    )
    return df.select(
        *keys, "ortg_before", "ortg_after", "drtg_before", "drtg_after",
        (F.col("ortg_after") - F.col("ortg_before")).alias("ortg_impact"),
        (F.col("drtg_after") - F.col("drtg_before")).alias("drtg_impact"),
    )


def momentum_timeline(pbp: DataFrame) -> DataFrame:
    return pbp.filter(
        (X.points_of("playtype") > 0) & F.col("points_a").isNotNull() & F.col("points_b").isNotNull()
    ).select(
        *_G, F.col(C.PLAY_ORDER).alias("play_number"), "period", F.col("markertime").alias("time"), "clock_secs",
        F.col("points_a").alias("home_score"), F.col("points_b").alias("away_score"),
        (F.col("points_a") - F.col("points_b")).alias("score_diff"),
        F.col("codeteam").alias("scoring_team"), "player", F.col("playtype").alias("play_type"),
    )


def win_probability_timeline(pbp: DataFrame, ot_seconds: int = 300) -> DataFrame:
    left = X.remaining_seconds("period", "clock_secs", ot_seconds)
    home = X.live_win_probability("home_score", "away_score", left)
    return momentum_timeline(pbp).select(
        *_G, "play_number", "period", "time", "home_score", "away_score",
        home.alias("home_wp"), (1.0 - home).alias("away_wp"),
    )


def live_score(pbp: DataFrame, ot_seconds: int = 300) -> DataFrame:
    """Latest score and game clock per game; a single aggregate, so it also runs on a stream."""
    both = F.col("points_a").isNotNull() & F.col("points_b").isNotNull()
    agg = pbp.groupBy(*_G).agg(
        F.max_by(F.struct("points_a", "points_b"), F.when(both, F.col(C.PLAY_ORDER))).alias("s"),
        F.max_by(F.struct("period", "markertime", "clock_secs"), F.col(C.PLAY_ORDER)).alias("c"),
    )
    p, secs = F.col("c.period"), F.col("c.clock_secs")
    return agg.select(
        *_G, F.coalesce("s.points_a", F.lit(0)).alias("home_score"), F.coalesce("s.points_b", F.lit(0)).alias("away_score"),
        p.alias("period"), F.col("c.markertime").alias("time_remaining"),
        F.greatest(X.elapsed_seconds(p, secs, ot_seconds), F.lit(0)).alias("total_seconds_elapsed"),
        X.remaining_seconds(p, secs, ot_seconds).alias("total_seconds_remaining"),
    )
