"""Clutch time: fourth quarter or overtime, last five minutes, margin of five or less."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X
from courtlake.functions.scans import running

_G = C.GAME_KEYS


def filled_score(pbp: DataFrame, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Running score on every play, carried forward over the rows that show none."""
    shown = F.when(
        F.col("points_a").isNotNull() & F.col("points_b").isNotNull(), F.struct("points_a", "points_b")
    )
    df = running(pbp, _G, C.PLAY_ORDER, lasts={"__score": shown}, block=block)
    return df.withColumns(
        {"score_a": F.coalesce("__score.points_a", F.lit(0)), "score_b": F.coalesce("__score.points_b", F.lit(0))}
    ).drop("__score")


def clutch_plays(pbp: DataFrame, score_fill: str = "forward", block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Clutch plays. ``score_fill='zero'`` treats a play without score as tied instead."""
    late = (F.col("period") >= 4) & (F.col("clock_secs") <= 300)
    if score_fill == "zero":
        a, b = F.coalesce("points_a", F.lit(0)), F.coalesce("points_b", F.lit(0))
        return pbp.filter(late & (F.abs(a - b) <= 5))
    close = F.abs(F.col("score_a") - F.col("score_b")) <= 5
    return filled_score(pbp, block).filter(late & close).drop("score_a", "score_b")


def clutch_shots(shots: DataFrame) -> DataFrame:
    a, b = F.coalesce("points_a", F.lit(0)), F.coalesce("points_b", F.lit(0))
    return shots.filter((F.coalesce("minute", F.lit(0)) >= 36) & (F.abs(a - b) <= 5))


def _counts(pt: str = "playtype") -> dict:
    return {
        "fgm2": X.count_of(pt, "2FGM"), "fga2": X.count_of(pt, "2FGM", "2FGA"),
        "fgm3": X.count_of(pt, "3FGM"), "fga3": X.count_of(pt, "3FGM", "3FGA"),
        "ftm": X.count_of(pt, "FTM"), "fta": X.count_of(pt, "FTM", "FTA"),
        "off_rebounds": X.count_of(pt, "O"), "def_rebounds": X.count_of(pt, "D"),
        "total_rebounds": X.count_of(pt, "O", "D"), "assists": X.count_of(pt, "AS"), "steals": X.count_of(pt, "ST"),
        "turnovers": X.count_of(pt, "TO"), "blocks_favour": X.count_of(pt, "FV"),
        "fouls_committed": X.count_of(pt, *C.FOUL_PLAYS), "fouls_received": X.count_of(pt, "RV"),
        "points": F.sum(X.points_of(pt)),
    }


def clutch_stats(clutch: DataFrame, box: DataFrame) -> DataFrame:
    """Per game and player: points, attempts, TS% and the share of the game's clutch possessions used."""
    fga = F.count_if(F.col("playtype").isin(C.FIELD_GOAL_PLAYS))
    fta = F.count_if(F.col("playtype").isin(C.FREE_THROW_PLAYS))
    per_player = clutch.filter(F.col("player_id").isNotNull()).groupBy(*_G, "player_id").agg(
        F.mode("codeteam", True).alias("team"), F.count("*").alias("clutch_actions"),
        F.sum(X.points_of("playtype")).alias("clutch_points"), fga.alias("clutch_fga"), fta.alias("clutch_fta"),
        X.count_of("playtype", "TO").alias("clutch_turnovers"),
    )
    used = lambda a, f, t: F.col(a) * 100 + F.col(f) * 44 + F.col(t) * 100
    whole = clutch.groupBy(*_G).agg(fga.alias("gf"), fta.alias("gt"), X.count_of("playtype", "TO").alias("gv"))
    names = box.groupBy(*_G, "player_id").agg(F.min("player_name").alias("player_name"))
    return (
        per_player.join(whole, _G).join(names, [*_G, "player_id"], "left")
        .select(
            *_G, "player_id", F.coalesce("player_name", "player_id").alias("player_name"), "team", "clutch_actions",
            "clutch_points", "clutch_fga", "clutch_fta", "clutch_turnovers",
            X.true_shooting("clutch_points", "clutch_fga", "clutch_fta").alias("clutch_ts_pct"),
            X.ratio(used("clutch_fga", "clutch_fta", "clutch_turnovers"), used("gf", "gt", "gv")).alias("clutch_usage"),
        )
    )


def clutch_boxscore(clutch: DataFrame, box: DataFrame) -> DataFrame:
    """Boxscore rows rebuilt from clutch plays; minutes are the clock span, at least half a minute."""
    counts = clutch.filter(F.col("player_id").isNotNull()).groupBy(*_G, "player_id").agg(
        *[c.alias(n) for n, c in _counts().items()],
        F.mode("codeteam", True).alias("__team"), F.mode("player", True).alias("__name"),
        F.greatest(F.max("clock_secs") - F.min("clock_secs"), F.lit(30)).cast("int").alias("seconds"),
    )
    meta = box.select(
        *_G, "player_id", "player_name", "team_code", "is_home", "is_starter", "is_playing"
    ).dropDuplicates([*_G, "player_id"])
    zero = F.lit(0)
    return counts.join(meta, [*_G, "player_id"], "left").select(
        *_G, "player_id", F.coalesce("player_name", "__name", "player_id").alias("player_name"),
        F.coalesce("team_code", "__team").alias("team_code"), F.coalesce("is_home", zero).alias("is_home"),
        F.coalesce("is_starter", zero).alias("is_starter"), F.coalesce("is_playing", zero).alias("is_playing"),
        F.format_string("%d:%02d", F.expr("seconds div 60"), F.col("seconds") % 60).alias("minutes_str"),
        "seconds", (F.col("seconds") / 60.0).alias("minutes"),
        *[c for c in C.COUNT_STATS if c not in ("blocks_against", "plus_minus")],
        zero.alias("blocks_against"), zero.alias("plus_minus"),
    )
