"""Box-score statistics: partial aggregation per game and team, joined back to the player rows.

Team totals are joined, not windowed: the aggregate combines map-side and the
join can be split by AQE, so one oversized game never lands in a single task. Hints keep
the boxscores, whose files are many times smaller than their rows, off the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X

TEAM_GAME = ["season", "gamecode", "team_code"]
SEASON_SUMS = [
    "minutes", "points", "fgm2", "fga2", "fgm3", "fga3", "ftm", "fta", "off_rebounds", "def_rebounds",
    "total_rebounds", "assists", "steals", "turnovers", "blocks_favour", "blocks_against",
    "fouls_committed", "fouls_received", "possessions",
]


def team_possessions(box: DataFrame) -> DataFrame:
    """Per game and team: eight sums and the possession estimate FGA + .44 FTA - ORB + TOV."""
    sums = box.groupBy(*TEAM_GAME).agg(
        F.sum(F.col("fga2") + F.col("fga3")).alias("team_fga"),
        F.sum("fta").alias("team_fta"), F.sum("off_rebounds").alias("team_orb"), F.sum("turnovers").alias("team_tov"),
        F.sum("points").alias("team_points"), F.sum("seconds").alias("team_seconds"),
        F.sum("assists").alias("team_assists"), F.sum("fouls_received").alias("team_fouls_received"),
    )
    poss = X.possessions100("team_fga", "team_fta", "team_orb", "team_tov")
    return sums.withColumns({"team_minutes": F.col("team_seconds") / 60.0, "team_poss": poss / 100.0})


def defensive_ratings(team_poss: DataFrame) -> DataFrame:
    """Opponent points over own possessions, NULL where a game has only one team."""
    game = team_poss.groupBy(*C.GAME_KEYS).agg(
        F.sum("team_points").alias("game_points"), F.count("*").alias("game_teams")
    )
    opp = F.when(F.col("game_teams") >= 2, F.col("game_points") - F.col("team_points"))
    return team_poss.join(game.hint("merge"), C.GAME_KEYS).select(
        *TEAM_GAME, "team_poss", "team_points", opp.alias("opp_points"),
        F.when(F.col("team_poss") > 0, opp / F.col("team_poss") * 100).alias("def_rating"),
    )


def advanced_stats(box: DataFrame) -> DataFrame:
    """Per player and game: possessions by minute share, TS%, ORtg, DRtg, usage and stop rate."""
    team = team_possessions(box)
    context = defensive_ratings(team).select(*TEAM_GAME, "def_rating").join(
        team.select(*TEAM_GAME, "team_poss", "team_seconds").hint("merge"), TEAM_GAME
    )
    fga = F.col("fga2") + F.col("fga3")
    share = F.when(F.col("team_seconds") > 0, F.col("seconds") / F.col("team_seconds")).otherwise(0.0)
    poss = F.col("possessions")
    stops = F.col("steals") + F.col("blocks_favour") + F.col("def_rebounds")
    used = X.involvement100(fga, "fta", "turnovers", "assists", "fouls_received")
    return (
        box.join(context.hint("merge"), TEAM_GAME)
        .withColumn("possessions", F.col("team_poss") * share)
        .select(
            "season", "gamecode", "player_id", "player_name", "team_code", "is_home", "seconds", "minutes",
            *C.COUNT_STATS, "possessions",
            X.true_shooting("points", fga, "fta").alias("ts_pct"),
            F.when(poss > 0, F.col("points") / poss * 100).alias("off_rating"),
            "def_rating",
            F.when(poss > 0, used / 100.0 / poss).alias("true_usg_pct"),
            F.when(poss > 0, stops / poss).alias("stop_rate"),
        )
    )


def season_player_stats(adv: DataFrame, team_code: str | None = None) -> DataFrame:
    """Season sums per team and player with rates derived again from the sums; idle players dropped."""
    rows = adv if team_code is None else adv.filter(F.col("team_code") == team_code)
    sums = rows.groupBy("season", "team_code", "player_id").agg(
        F.min_by("player_name", "gamecode").alias("player_name"), F.sum("seconds").alias("seconds"),
        *[F.sum(c).alias(c) for c in SEASON_SUMS if c != "minutes"],
    ).withColumn("minutes", F.col("seconds") / 60.0)
    fga, poss = F.col("fga2") + F.col("fga3"), F.col("possessions")
    used = X.involvement100(fga, "fta", "turnovers", "assists", "fouls_received")
    return (
        sums.filter(F.col("seconds") > 0)
        .withColumns(
            {
                "ts_pct": X.true_shooting("points", fga, "fta"),
                "true_usg_pct": F.when(poss > 0, used / 100.0 / poss),
                "stop_rate": F.when(poss > 0, (F.col("steals") + F.col("blocks_favour") + F.col("def_rebounds")) / poss),
                "off_rating": F.when(poss > 0, F.col("points") / poss * 100),
            }
        )
        .orderBy("season", "team_code", F.desc("seconds"))
    )


def team_averages(adv: DataFrame) -> DataFrame:
    return (
        adv.filter(F.col("seconds") > 0)
        .groupBy("season", "team_code")
        .agg(
            F.countDistinct("gamecode").alias("games_played"), F.avg("points").alias("avg_points"),
            F.avg("ts_pct").alias("avg_ts_pct"), F.avg("off_rating").alias("avg_off_rating"),
            F.avg("def_rating").alias("avg_def_rating"), F.avg("possessions").alias("avg_possessions"),
        )
        .orderBy("season", F.desc("avg_off_rating"))
    )


def total_points_created(adv: DataFrame, links: DataFrame) -> DataFrame:
    """Own points plus the points of the baskets the player assisted, per game."""
    created = links.groupBy("season", "gamecode", F.col("passer_id").alias("player_id")).agg(
        F.sum("shot_value").alias("pts_from_assists")
    )
    return (
        adv.join(created, [*C.GAME_KEYS, "player_id"], "left")
        .withColumn("pts_from_assists", F.coalesce("pts_from_assists", F.lit(0)))
        .withColumn("total_pts_created", F.col("points") + F.col("pts_from_assists"))
    )


def classify_positions(box: DataFrame) -> DataFrame:
    """Per game and team: top-2 assist-to-rebound players Guards, then the top rebound-to-assist player Center."""
    ast = F.col("assists") / (F.greatest(F.col("total_rebounds"), F.lit(0)) + 1)
    reb = F.col("total_rebounds") / (F.greatest(F.col("assists"), F.lit(0)) + 1)
    team = Window.partitionBy(*TEAM_GAME)
    played = box.filter(F.col("seconds") > 0).select(
        *TEAM_GAME, "player_id",
        F.row_number().over(team.orderBy(ast.desc(), "player_id")).alias("ast_rank"),
        F.count("*").over(team).alias("team_size"), reb.alias("reb_ratio"),
    )
    guard = F.col("ast_rank") <= 2
    ranked = played.filter(F.col("team_size") >= 3).withColumn(
        "reb_rank", F.row_number().over(team.orderBy(guard, F.desc("reb_ratio"), "player_id"))
    )
    special = ranked.select(
        *TEAM_GAME, "player_id", F.when(guard, "Guard").when(F.col("reb_rank") == 1, "Center").alias("found")
    )
    return box.join(special, [*TEAM_GAME, "player_id"], "left").withColumn(
        "position", F.coalesce("found", F.lit("Forward"))
    ).drop("found")


def positional_scoring(box: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Share of team points per position for every season and team; all three positions always present."""
    if players is not None:
        pos = players.select("player_id", X.position_label("position").alias("position"))
        rows = box.join(pos, "player_id", "left").withColumn("position", F.coalesce("position", F.lit("Forward")))
    else:
        rows = classify_positions(box)
    sums = rows.groupBy("season", "team_code").agg(
        F.sum("points").alias("total"),
        *[F.sum(F.when(F.col("position") == p, F.col("points")).otherwise(0)).alias(p) for p in C.POSITIONS],
    )
    long = sums.select(
        "season", "team_code", "total",
        F.explode(F.create_map(*[x for p in C.POSITIONS for x in (F.lit(p), F.col(p))])).alias("position", "points"),
    )
    share = F.when(F.col("total") > 0, F.col("points") / F.col("total") * 100).otherwise(0.0)
    return long.select("season", "team_code", "position", "points", share.alias("pct"))


LEADER_SUMS = {
    "points": "points", "fgm2": "fgm2", "fga2": "fga2", "fgm3": "fgm3", "fga3": "fga3", "ftm": "ftm", "fta": "fta",
    "total_rebounds": "rebounds", "assists": "assists", "turnovers": "turnovers", "steals": "steals",
    "blocks_favour": "blocks",
}


def league_leaders(adv: DataFrame, teams: DataFrame, per_game: bool = False) -> DataFrame:
    """Season totals with FG2/FG3/FT percentages, or the per-game view of the same rows."""
    totals = (
        adv.filter(F.col("seconds") > 0)
        .groupBy("season", F.col("player_id").alias("player_code"), F.col("player_name").alias("player_name_raw"), "team_code")
        .agg(
            F.countDistinct("gamecode").alias("games"), F.sum("seconds").alias("seconds"),
            *[F.sum(c).alias(n) for c, n in LEADER_SUMS.items()],
        )
        .withColumn("minutes", F.col("seconds") / 60.0)
        .drop("seconds")
        .join(teams.select("team_code", "team_name"), "team_code", "left")
        .withColumns(
            {
                "player_name": X.display_name("player_name_raw"),
                "fg2_pct": X.ratio0("fgm2", "fga2") * 100,
                "fg3_pct": X.ratio0("fgm3", "fga3") * 100,
                "ft_pct": X.ratio0("ftm", "fta") * 100,
            }
        )
    )
    if not per_game:
        return totals
    return totals.withColumns({c: X.ratio0(c, "games") for c in ["minutes", *LEADER_SUMS.values()]})


def game_summary(adv: DataFrame) -> DataFrame:
    """Per game: active players and their mean TS%, ORtg, DRtg, usage and net rating."""
    return adv.filter(F.col("seconds") > 0).groupBy(*C.GAME_KEYS).agg(
        F.count("*").alias("players"), F.avg("ts_pct").alias("avg_ts_pct"), F.avg("off_rating").alias("avg_off_rating"),
        F.avg("def_rating").alias("avg_def_rating"), F.avg("true_usg_pct").alias("avg_true_usg_pct"),
        F.avg(F.col("off_rating") - F.col("def_rating")).alias("avg_net_rating"),
    )


COMPARED = ["off_rating", "def_rating", "ts_pct", "true_usg_pct", "stop_rate"]


def player_comparison(adv: DataFrame) -> DataFrame:
    """Min-max normalised ratings of every active player within a game; DRtg inverted."""
    active = adv.filter(F.col("seconds") > 0)
    bounds = active.groupBy(*C.GAME_KEYS).agg(
        *[F.min(c).alias(f"{c}_lo") for c in COMPARED], *[F.max(c).alias(f"{c}_hi") for c in COMPARED]
    )

    def norm(c: str):
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        n = (F.col(c) - F.col(f"{c}_lo")) / F.when(span == 0, 1.0).otherwise(span)
        return (1 - n if c == "def_rating" else n).alias(f"{c}_norm")

    return active.join(bounds, C.GAME_KEYS).select(
        *C.GAME_KEYS, "player_id", "player_name", "team_code", *[norm(c) for c in COMPARED]
    )
