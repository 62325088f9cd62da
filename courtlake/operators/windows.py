"""Form, rest days, streaks and ranks. A window here spans one team's or player's season (at most a few dozen games)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from courtlake import config as C
from courtlake.operators.league import team_games

def _team():
    return Window.partitionBy("season", "team_code")



def recent_form(games: DataFrame, n: int = 5) -> DataFrame:
    """Mean point difference of the last ``n`` games played in earlier rounds; 0 without any."""
    done = F.coalesce(F.col("played"), F.lit(False)) & F.col("pts_for").isNotNull() & F.col("pts_against").isNotNull()
    df = team_games(games).withColumn("done", done)
    last = Window.partitionBy("season", "team_code", "done").orderBy("round", "gamecode").rowsBetween(1 - n, 0)
    after = F.when(F.col("done"), F.struct("round", "gamecode", F.avg(F.col("pts_for") - F.col("pts_against")).over(last).alias("form")))
    earlier = _team().orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("after", after)
    return df.select(
        "season", "gamecode", "team_code", "is_home", "round", F.coalesce(F.max("after").over(earlier)["form"], F.lit(0.0)).alias("form"),
    )


def rest_days(games: DataFrame) -> DataFrame:
    """Days since the team's last played game of an earlier round: 3 without a date, 7 without a game, never negative."""
    earlier = _team().orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    df = team_games(games).withColumns(
        {
            "n": F.count(F.when(F.col("played"), 1)).over(earlier),
            "last_day": F.max(F.when(F.col("played"), F.col("game_day"))).over(earlier),
        }
    )
    rest = (
        F.when(F.col("game_day").isNull(), 3).when(F.col("n") == 0, 7).when(F.col("last_day").isNull(), 3)
        .otherwise(F.greatest(F.date_diff("game_day", "last_day"), F.lit(0)))
    )
    return df.select("season", "gamecode", "team_code", "is_home", "round", rest.alias("rest_days"))


def rest_days_latest(games: DataFrame, as_of) -> DataFrame:
    return team_games(games).groupBy("season", "team_code").agg(
        F.max(F.when(F.col("played"), F.col("game_day"))).alias("last_day")
    ).select(
        "season", "team_code",
        F.when(F.col("last_day").isNull(), 3).otherwise(F.greatest(F.date_diff(as_of, "last_day"), F.lit(0))).alias("rest_days"),
    )


def player_form(per_game: DataFrame, metric: str = "total_pts_created", n: int = 5) -> DataFrame:
    """Rolling mean of a per-game measure, season mean, and whether the player is hot (above 110 % of it)."""
    keys = ["season", "team_code", "player_id"]
    rows = per_game.filter((F.col("seconds") > 0) & F.col(metric).isNotNull())
    season = rows.groupBy(*keys).agg(F.avg(metric).alias("season_avg"), F.count("*").alias("games")).filter("games >= 2")
    order = Window.partitionBy(*keys).orderBy("gamecode")
    rolled = rows.select(
        *keys, "player_name", "gamecode", F.col(metric).cast("double").alias("value"),
        F.row_number().over(order).alias("game_num"), F.avg(metric).over(order.rowsBetween(-(n - 1), 0)).alias("rolling_avg"),
    )
    return rolled.join(season, keys).withColumn("is_hot", F.col("rolling_avg") > F.col("season_avg") * 1.10)


def form_summary(form: DataFrame) -> DataFrame:
    """Season mean, best game, latest rolling mean and trend in percent of the season mean."""
    latest = F.max_by("rolling_avg", "game_num")
    return form.groupBy("season", "team_code", "player_id").agg(
        F.max("season_avg").alias("season_avg"), F.max("value").alias("best"), latest.alias("last_avg"), F.count("*").alias("games")
    ).withColumn(
        "trend_pct", F.when(F.col("season_avg") != 0, (F.col("last_avg") - F.col("season_avg")) / F.col("season_avg") * 100).otherwise(0.0)
    )


def hot_streaks(form: DataFrame) -> DataFrame:
    keys = ["season", "team_code", "player_id"]
    # Within the hot rows, game number minus rank is constant along one streak.
    island = F.col("game_num") - F.row_number().over(Window.partitionBy(*keys).orderBy("game_num"))
    return form.filter("is_hot").withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("game_num").alias("start_game"), F.max("game_num").alias("end_game")
    ).drop("island")


def percentile_ranks(df: DataFrame, columns: list[str] | None = None, inverted: tuple[str, ...] = ("tov_pct",)) -> DataFrame:
    """Average rank over count, times 100, within the season; inverted measures count down."""
    columns = columns or C.FOUR_FACTORS
    season = Window.partitionBy("season")
    n = F.count("*").over(season)

    def pct(c: str):
        ties = F.count("*").over(Window.partitionBy("season", c))
        rank = F.rank().over(season.orderBy(c)) + (ties - 1) / 2.0
        value = rank / n * 100
        return 100 - value if c in inverted else value

    return df.withColumns({f"{c}_pctl": pct(c) for c in columns})


def movers(projection: DataFrame) -> DataFrame:
    """Current rank, distance to the projected rank, and bubble teams: those projected two places around the line between sixth and seventh."""
    rank = F.row_number().over(
        Window.partitionBy("season").orderBy(F.desc("current_wins"), F.round("expected_wins", 9).desc(), "team_code")
    )
    diff = F.col("current_rank") - F.col("proj_rank")
    return projection.withColumn("current_rank", rank).withColumns(
        {
            "rank_diff": diff, "movement": F.when(diff > 0, "riser").when(diff < 0, "faller").otherwise("steady"),
            "bubble": F.col("proj_rank").between(5, 8),
        }
    )


def standing_tier(rank) -> F.Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r == 1, "#1 Seed").when(r <= 4, "Home Court").when(r <= 6, "Playoffs").when(r <= 10, "Play-In").otherwise("Eliminated")
