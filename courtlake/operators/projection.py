"""Final standings from the win probabilities of the remaining fixtures, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from courtlake.functions import exprs as X
from courtlake.operators import filters, league


def _wins_of(chances) -> F.Column:
    """P(0 wins), P(1 win), ... over independent games with the given chances, one game folded in after the other."""
    more = lambda d, p: F.zip_with(
        F.concat(F.transform(d, lambda x: x * (1 - p)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(d, lambda x: x * p)), lambda a, b: a + b)
    return F.aggregate(chances, F.array(F.lit(1.0)), more)


def project_standings(games: DataFrame, efficiency: DataFrame) -> DataFrame:
    """Per season and team: expected wins and losses at the season's end, their rank, and ``distribution``, the exact
    probability of each number of wins from the current one up. Equal expectations keep code order. A season without
    fixtures has its current table. The list folded per team is no longer than a team's fixtures in a season.
    """
    standings = league.current_standings(games)
    rating = efficiency.select("season", F.col("team_code"), "net_rtg")
    side = lambda s: rating.select("season", F.col("team_code").alias(f"{s}_team"), F.col("net_rtg").alias(f"{s}_net"))
    fixtures = (
        filters.remaining_games(games)
        .join(side("home"), ["season", "home_team"], "left").join(side("away"), ["season", "away_team"], "left")
        .na.fill(0.0, ["home_net", "away_net"]).withColumn("p", X.win_probability("home_net", "away_net"))
    )
    of = lambda team, p: F.struct(F.col(team).alias("team_code"), p.alias("p"))
    chances = fixtures.select("season", "gamecode", F.explode(F.array(of("home_team", F.col("p")), of("away_team", 1 - F.col("p")))).alias("t"))
    ahead = chances.groupBy("season", "t.team_code").agg(
        F.count(F.lit(1)).alias("games_left"), F.array_sort(F.collect_list(F.struct("gamecode", F.col("t.p").alias("p")))).alias("g"))
    left = F.coalesce("games_left", F.lit(0))
    list_of = F.coalesce(F.transform("g", lambda x: x["p"]), F.array().cast("array<double>"))
    out = standings.join(ahead, ["season", "team_code"], "left").select(
        "season", "team_code", F.col("wins").alias("current_wins"), F.col("losses").alias("current_losses"), left.alias("games_left"), list_of.alias("p"),
    ).withColumn("gain", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    rank = F.row_number().over(Window.partitionBy("season").orderBy(F.round("expected_wins", 9).desc(), "team_code"))  # sums in another order are ties still
    return out.select(
        "season", "team_code", "current_wins", "current_losses", "games_left", (F.col("current_wins") + F.col("gain")).alias("expected_wins"),
        (F.col("current_losses") + F.col("games_left") - F.col("gain")).alias("expected_losses"), _wins_of(F.col("p")).alias("distribution"),
    ).withColumn("proj_rank", rank)


def win_table(projection: DataFrame) -> DataFrame:
    """One row per team and possible number of wins with its probability in percent."""
    return projection.select("season", "team_code", "current_wins", F.posexplode("distribution").alias("more", "p")).select(
        "season", "team_code", (F.col("current_wins") + F.col("more")).alias("wins"), (F.col("p") * 100).alias("pct"))
