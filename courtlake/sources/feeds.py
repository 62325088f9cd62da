"""Reading landed feed files, and deriving schedule and game tables from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlake import config as C, schemas as S
from courtlake.functions import exprs as X
from courtlake.sources import files
from courtlake.sources.clean import clean_boxscores, clean_play_by_play, clean_schedule, clean_shots

_G = C.GAME_KEYS


def read_landing(spark: SparkSession, paths: str | list[str], schema: str, fmt: str | None = None) -> DataFrame:
    """Read landed files of one feed with a declared schema; paths that do not exist count as empty. ``ingest`` remembers what it has read."""
    first = paths if isinstance(paths, str) else paths[0]
    paths = [p for p in ([paths] if isinstance(paths, str) else paths) if files.matches(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    fmt = fmt or first.rstrip("/").rsplit(".", 1)[-1].split("/")[-1].lower()
    fmt = fmt if fmt in ("parquet", "json", "csv", "orc") else "parquet"
    reader = spark.read.schema(schema).format(fmt).option("ignoreMissingFiles", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(paths)


def read_boxscores(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    return clean_boxscores(read_landing(spark, paths, S.RAW_BOXSCORE, fmt))


def read_play_by_play(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    return clean_play_by_play(read_landing(spark, paths, S.RAW_PLAY_BY_PLAY, fmt))


def read_shots(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    return clean_shots(read_landing(spark, paths, S.RAW_SHOTS, fmt))


def select_games(df: DataFrame, season: int | None = None, gamecodes: list[int] | None = None, team: str | None = None,
                 team_columns: tuple[str, ...] = ("team_code",)) -> DataFrame:
    """Season, game and team filters of a many-game extract; the season filter prunes partitions."""
    if season is not None:
        df = df.filter(F.col("season") == season)
    if gamecodes is not None:
        df = df.filter(F.col("gamecode").isin(gamecodes))
    if team is not None:
        hit = F.lit(False)
        for c in team_columns:
            hit = hit | (F.col(c) == team)
        df = df.filter(hit)
    return df


def team_season_extract(box: DataFrame, games: DataFrame, team: str) -> DataFrame:
    """All boxscore rows, both sides, of the games one team has played."""
    mine = games.filter(F.col("played") & ((F.col("home_team") == team) | (F.col("away_team") == team))).select(*_G)
    return box.join(mine, _G, "left_semi")


def club_logos(extra_rounds: DataFrame) -> DataFrame:
    """Logo per club from the nested per-round feed."""
    club = lambda side: F.struct(
        X.team_alias(f"{side}.club.code").alias("team_code"), F.col(f"{side}.club.images.crest").alias("logo_url")
    )
    return extra_rounds.select(F.explode(F.array(club("local"), club("road"))).alias("c")).groupBy("c.team_code").agg(
        F.max("c.logo_url").alias("logo_url")
    )


def season_schedule(raw: DataFrame, logos: DataFrame | None = None) -> DataFrame:
    df = clean_schedule(raw)
    if logos is not None:
        side = lambda s: logos.select(F.col("team_code").alias(f"{s}_code"), F.col("logo_url").alias(f"{s}_logo"))
        df = df.join(side("home"), "home_code", "left").join(side("away"), "away_code", "left").na.fill("", ["home_logo", "away_logo"])
    return df.orderBy("season", "round", "gamecode")


def extra_rounds(raw: DataFrame) -> DataFrame:
    """Flatten the nested per-round feed; a round of another phase ends the regular season there."""
    phase = F.upper(F.coalesce("Phase", F.lit("RS")))
    return raw.filter(phase == "RS").select(
        "season", "round", F.lit("RS").alias("round_name"), F.col("gameCode").alias("gamecode"),
        F.coalesce("played", F.lit(False)).alias("played"),
        X.team_alias("local.club.code").alias("home_code"), F.col("local.club.name").alias("home_name"),
        F.col("local.score").alias("home_score"), X.team_alias("road.club.code").alias("away_code"),
        F.col("road.club.name").alias("away_name"), F.col("road.score").alias("away_score"),
        F.col("local.club.images.crest").alias("home_logo"), F.col("road.club.images.crest").alias("away_logo"),
        X.clean_text("date").alias("date"), X.game_date("date").alias("game_day"),
    )


def full_schedule(schedule: DataFrame, extra: DataFrame, as_of) -> DataFrame:
    """Regular season incl. rescheduled rounds; games dated after ``as_of`` count as not played."""
    base = schedule.filter(F.col("round_name").isNull() | (F.upper("round_name") == "RS"))
    new = extra.join(base.select(*_G), _G, "left_anti")
    both = base.unionByName(new, allowMissingColumns=True).filter(F.col("round") <= C.MAX_REGULAR_SEASON_ROUND)
    future = F.coalesce("played", F.lit(False)) & F.coalesce(F.col("game_day") > as_of, F.lit(False))
    return both.withColumns(
        {
            "home_score": F.when(~future, F.col("home_score")), "away_score": F.when(~future, F.col("away_score")),
            "played": F.col("played") & ~future,
        }
    )


def game_metadata(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"CodeTeamA": X.team_alias("CodeTeamA"), "CodeTeamB": X.team_alias("CodeTeamB")}).select(
        F.col("Season").alias("season"), F.col("Gamecode").alias("gamecode"), F.col("Round").alias("round"),
        F.col("CodeTeamA").alias("home_team"), F.col("CodeTeamB").alias("away_team"), F.col("ScoreA").alias("home_score"),
        F.col("ScoreB").alias("away_score"), F.col("CoachA").alias("home_coach"), F.col("CoachB").alias("away_coach"),
        F.col("Stadium").alias("stadium"),
        *[X.clean_text(f"Referee{i}").alias(f"referee{i}") for i in (1, 2, 3)],
    )


def game_info(box: DataFrame, pbp: DataFrame) -> DataFrame:
    """Teams from the home flag; final score from the last scored play, else the boxscore sums."""
    side = lambda flag, c: F.when(F.col("is_home") == flag, F.col(c))
    teams = box.groupBy(*_G).agg(
        F.min(side(1, "team_code")).alias("home_team"), F.min(side(0, "team_code")).alias("away_team"),
        F.sum(side(1, "points")).alias("hp"), F.sum(side(0, "points")).alias("ap"),
    )
    shown = F.col("points_a").isNotNull() & F.col("points_b").isNotNull() & (F.col("points_a") > 0)
    last = pbp.groupBy(*_G).agg(
        F.max_by(F.struct("points_a", "points_b"), F.when(shown, F.col(C.PLAY_ORDER))).alias("s")
    )
    has = F.col("s").isNotNull()
    return teams.join(last, _G, "left").select(
        *_G, "home_team", "away_team", F.when(has, F.col("s.points_a")).otherwise(F.col("hp").cast("int")).alias("home_score"),
        F.when(has, F.col("s.points_b")).otherwise(F.col("ap").cast("int")).alias("away_score"), F.lit(True).alias("played"),
    )


def games_table(schedule: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    df = schedule.select(
        *_G, F.col("home_code").alias("home_team"), F.col("away_code").alias("away_team"), "home_score", "away_score",
        F.col("date").alias("game_date"), "game_day", "round", "played",
    )
    if metadata is None:
        return df
    return df.join(metadata.select(*_G, "referee1", "referee2", "referee3"), _G, "left")


def teams_table(schedule: DataFrame, logos: DataFrame | None = None) -> DataFrame:
    """One row per club over all seasons with its name, and its logo where known."""
    club = lambda s: F.struct(F.col(f"{s}_code").alias("team_code"), F.col(f"{s}_name").alias("team_name"))
    df = schedule.select(F.explode(F.array(club("home"), club("away"))).alias("c")).groupBy("c.team_code").agg(
        F.max("c.team_name").alias("team_name")
    )
    if logos is None:
        return df.withColumn("logo_url", F.lit(None).cast("string"))
    return df.join(logos, "team_code", "left")


def todays_games(games: DataFrame, as_of) -> DataFrame:
    return games.filter(F.col("game_day") == as_of)


def live_games(games: DataFrame, pbp: DataFrame, as_of) -> DataFrame:
    """Scheduled today, not final, and with plays already on record."""
    return todays_games(games, as_of).filter(~F.col("played")).join(pbp.select(*_G), _G, "left_semi")


def missing_games(schedule: DataFrame, boxscores: DataFrame) -> DataFrame:
    """Played on the schedule but not loaded."""
    return schedule.filter("played").select(*_G).join(boxscores.select(*_G), _G, "left_anti")
