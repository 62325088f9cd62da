"""Dashboard filters as pushed-down predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X


def search_player_stats(adv: DataFrame, season: int | None = None, team_code: str | None = None, player_name: str | None = None) -> DataFrame:
    if season is not None:
        adv = adv.filter(F.col("season") == season)
    if team_code:
        adv = adv.filter(F.col("team_code") == team_code)
    if player_name:
        adv = adv.filter(F.col("player_name").ilike(f"%{player_name}%"))
    return adv.orderBy(F.desc("points"))


def qualified_leaders(leaders: DataFrame, per_game: bool = False, **limits: int) -> DataFrame:
    """Mark rows that qualify for the volume boards and for each percentage board."""
    q = {**C.LEADER_DEFAULTS, **limits}
    total = lambda c: F.col(c) * F.col("games") if per_game else F.col(c)
    return leaders.filter(F.col("games") >= q["min_games"]).withColumns(
        {
            "q_fg2": total("fga2") >= q["min_fga2"], "q_fg3": total("fga3") >= q["min_fga3"], "q_ft": total("fta") >= q["min_fta"],
        }
    )


def scout_filter(
    pool: DataFrame, positions: list[str], age: tuple[int, int], height: tuple[int, int],
    min_minutes: float = 0, min_games: int = 1, min_ts: float = 0, max_usg: float = 10,
) -> DataFrame:
    """Range filters on age and height apply only in seasons where the value is known for anyone."""
    known = pool.groupBy("season").agg(F.count("age").alias("n_age"), F.count("height").alias("n_height"))
    in_range = lambda c, n, r: (F.col(n) == 0) | (F.col(c).isNotNull() & F.col(c).between(*r))
    return (
        pool.join(known, "season")
        .filter(in_range("age", "n_age", age) & in_range("height", "n_height", height))
        .filter(X.position_label("position").isin(positions))
        .filter((F.col("minutes_pg") >= min_minutes) & (F.col("games") >= min_games))
        .filter(F.col("ts_pct").isNull() | (F.col("ts_pct") >= min_ts / 100.0))
        .filter(F.col("true_usg_pct").isNull() | (F.col("true_usg_pct") <= max_usg))
        .drop("n_age", "n_height")
    )


def similarity_pool_filter(pool: DataFrame, min_minutes: float = 0, position: str | None = None) -> DataFrame:
    df = pool.filter(F.col("minutes_pg") >= min_minutes)
    return df if position is None else df.filter(F.col("position") == position)


def team_season_shots(shots: DataFrame, team_code: str, season: int | None = None) -> DataFrame:
    """A team's shots under its present and its former code, in game order."""
    df = shots.filter(F.col("team").isin(X.alias_codes(team_code)))
    if season is not None:
        df = df.filter(F.col("season") == season)
    return df.orderBy("season", "gamecode", "minute")


def season_schedule(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Schedule with club names and logos, round label and matchup text."""
    club = lambda s: teams.select(
        F.col("team_code").alias(f"{s}_team"), F.col("team_name").alias(f"{s}_name"), F.col("logo_url").alias(f"{s}_logo")
    )
    mid = F.when(
        F.col("played") & F.col("home_score").isNotNull(), F.concat_ws("-", "home_score", "away_score")
    ).otherwise("vs")
    return (
        games.join(club("home"), "home_team", "left").join(club("away"), "away_team", "left")
        .withColumns({
            "round_label": F.concat(F.lit("Round "), F.col("round")),
            "matchup": F.concat_ws(" ", F.coalesce("home_name", "home_team"), mid, F.coalesce("away_name", "away_team")),
        })
        .withColumnsRenamed({"home_team": "home_code", "away_team": "away_code"})
        .orderBy("season", "round", "game_day", "gamecode")
    )


def round_bounds(games: DataFrame) -> DataFrame:
    """Next round to play and last round played per season."""
    return games.groupBy("season").agg(
        F.min(F.when(~F.col("played"), F.col("round"))).alias("upcoming_round"),
        F.max(F.when(F.col("played"), F.col("round"))).alias("last_played_round"),
    )


def remaining_games(games: DataFrame) -> DataFrame:
    return games.filter(~F.col("played")).select("season", "gamecode", "home_team", "away_team", "round")


def has_officials(games: DataFrame) -> DataFrame:
    """Per season: is any official known? An aggregate, so no row is pulled to the driver."""
    return games.groupBy("season").agg(F.coalesce(F.bool_or(F.col("referee1").isNotNull()), F.lit(False)).alias("has_referees"))
