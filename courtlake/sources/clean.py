"""Cleaning jobs: raw feed layout -> league tables, each one narrow projection over the whole feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X


def clean_boxscores(raw: DataFrame) -> DataFrame:
    """Drop summary rows, rename, parse minutes, coerce counts to 0, alias clubs, fill missing ids."""
    df = raw.filter(~F.coalesce(F.trim("Player_ID"), F.lit("")).isin("Team", "Total"))
    df = df.withColumnsRenamed({**C.BOX_COLUMNS, "Season": "season", "Gamecode": "gamecode"})
    synthetic = F.upper(F.concat_ws("_", F.regexp_replace("player_name", " ", "_"), F.trim("team_code")))
    counts = {c: F.coalesce(X.safe_double(c), F.lit(0.0)).cast("int") for c in C.COUNT_STATS}
    return df.withColumns(
        {
            "player_id": F.coalesce(X.clean_text("player_id"), synthetic),
            "player_name": F.trim("player_name"),
            "team_code": X.team_alias("team_code"),
            "is_home": X.safe_int("is_home"),
            "is_starter": X.safe_int("IsStarter"),
            "is_playing": X.safe_int("IsPlaying"),
            "seconds": X.clock_to_seconds("minutes_str"),
            "minutes": X.clock_to_minutes("minutes_str"),
            "valuation": X.safe_int("Valuation"),
            **counts,
        }
    ).select(
        "season", "gamecode", "player_id", "player_name", "team_code", "is_home", "is_starter", "is_playing",
        "dorsal", "minutes_str", "seconds", "minutes", *C.COUNT_STATS, "valuation",
    )


def clean_play_by_play(raw: DataFrame, keep: tuple[str, ...] = (), comment_length: int | None = None) -> DataFrame:
    """Trim ids, alias clubs, clock to seconds, score from the comment where the columns are empty.

    ``keep`` names raw columns to carry along, such as an event time; comments are cut only to a given length.
    """
    score = lambda column, side: F.coalesce(X.safe_double(column).cast("int"), X.comment_score("COMMENT", side))
    return raw.select(
        F.col("Season").alias("season"), F.col("Gamecode").alias("gamecode"),
        F.trim("PLAYTYPE").alias("playtype"),
        X.clean_text("PLAYER_ID").alias("player_id"), X.clean_text("PLAYER").alias("player"),
        F.nullif(X.team_alias("CODETEAM"), F.lit("")).alias("codeteam"),
        F.coalesce(X.safe_int("PERIOD"), F.lit(1)).alias("period"),
        F.col("MARKERTIME").alias("markertime"), X.clock_to_seconds("MARKERTIME").alias("clock_secs"),
        F.col("NUMBEROFPLAY").alias("numberofplay"),
        F.coalesce(F.col("TRUE_NUMBEROFPLAY"), F.col("NUMBEROFPLAY")).alias("true_numberofplay"),
        score("POINTS_A", 1).alias("points_a"), score("POINTS_B", 2).alias("points_b"),
        X.clean_text("COMMENT", comment_length).alias("comment"), *keep,
    )


def clean_shots(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("Season").alias("season"), F.col("Gamecode").alias("gamecode"), F.col("NUM_ANOT").alias("num_anot"),
        X.team_alias("TEAM").alias("team"), X.clean_text("ID_PLAYER").alias("id_player"),
        X.clean_text("PLAYER").alias("player"), F.trim("ID_ACTION").alias("id_action"), X.clean_text("ACTION").alias("action"),
        X.safe_int("POINTS").alias("points"), X.safe_double("COORD_X").alias("coord_x"), X.safe_double("COORD_Y").alias("coord_y"),
        X.clean_text("ZONE").alias("zone"), X.safe_int("FASTBREAK").alias("fastbreak"),
        X.safe_int("SECOND_CHANCE").alias("second_chance"),
        F.coalesce(X.safe_int(F.nullif(F.trim("POINTS_OFF_TURNOVER"), F.lit(""))), F.lit(0)).alias("pts_off_turnover"),
        F.col("MINUTE").alias("minute"), F.col("CONSOLE").alias("console"),
        X.safe_int("POINTS_A").alias("points_a"), X.safe_int("POINTS_B").alias("points_b"),
        F.when(F.col("ID_ACTION").contains("3FG"), 3).otherwise(2).alias("shot_value"),
        F.when(F.col("POINTS") > 0, 1).otherwise(0).alias("made"),
    )


def clean_schedule(raw: DataFrame) -> DataFrame:
    """Season list with typed scores (text that is no number becomes NULL) and a real date."""
    return raw.select(
        F.col("Season").alias("season"), F.col("Round").alias("round"), F.col("Phase").alias("round_name"),
        F.col("gameCode").alias("gamecode"), F.coalesce("played", F.lit(False)).alias("played"),
        X.team_alias("homecode").alias("home_code"), X.clean_text("hometeam").alias("home_name"),
        X.safe_int("homescore").alias("home_score"),
        X.team_alias("awaycode").alias("away_code"), X.clean_text("awayteam").alias("away_name"),
        X.safe_int("awayscore").alias("away_score"),
        X.clean_text("date").alias("date"), X.game_date("date").alias("game_day"),
        X.season_month(X.game_date("date")).alias("month_index"),
    )


def player_dimension(players: DataFrame, as_of) -> DataFrame:
    """Display name, age and bracket on ``as_of``, position bucket and archetype per player."""
    day = as_of if not isinstance(as_of, str) else F.to_date(F.lit(as_of))
    return players.select(
        "player_id", "player_name", "team_code", "dorsal", "height", "birthdate", "position", "country",
        X.display_name("player_name").alias("display_name"),
        X.age_on("birthdate", day).alias("age"),
        X.age_bracket(X.age_on("birthdate", day)).alias("age_bracket"),
        X.position_label("position").alias("position_group"),
        X.archetype(X.position_label("position"), "height").alias("archetype"),
    )
