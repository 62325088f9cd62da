"""Feeds in the league's raw column layout, derived from the ``events`` table.

The test tables hold no basketball data, so each event row becomes one play:
100 consecutive events are one game, 153 games (a full single round robin of 18
clubs) are one season. Everything is integer arithmetic on the event row, so
another SQL engine derives exactly the same feeds. Gamecodes restart every season. Game, player and roster sizes
are bounded by construction; the number of games grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CLUBS = "OLY,PAN,ULK,IST,TEL,BAS,RED,MCO,MAD,BAR,PAM,ZAL,PAR,MIL,MUN,VIR,ASV,BER"
SURNAMES = "VALE,O'DELL,MARSH-LEE,DE LUCA,KOSTA,BRANDT,NOVAK,SILVA,ORTEGA,PETROV,YILMAZ,HANSEN"
GIVEN = "ADAM,BRUNO,CARL,DINO,EMIL,FILIP,GORAN,HUGO,IVAN"
COUNTRIES = "GRE,ESP,TUR,ITA,SRB,FRA,LTU,GER,USA"
REFEREES = "REF ALFA,REF BRAVO,REF CHARLIE,REF DELTA,REF ECHO,REF FOXTROT,REF GOLF"
OFFICIAL_STEPS = (0, 2, 4)

# One SELECT list that Spark and DuckDB read alike; {div} and {k} are the only
# engine-specific tokens. Later aliases use earlier ones.
PLAY_FIELDS = """
  event_id, ts, user_id AS u, {k} AS k,
  event_id {div} 100 AS g, event_id % 100 AS p,
  g {div} 153 AS sn, g % 153 AS gi, gi {div} 9 AS r0, gi % 9 AS pair,
  CASE WHEN pair = 0 THEN 17 ELSE (r0 + pair) % 17 END AS club_a,
  CASE WHEN pair = 0 THEN r0 ELSE (r0 - pair + 17) % 17 END AS club_b,
  CASE WHEN (r0 + pair) % 2 = 0 THEN club_a ELSE club_b END AS hi,
  CASE WHEN (r0 + pair) % 2 = 0 THEN club_b ELSE club_a END AS ai,
  CASE WHEN g % 5 = 4 THEN 20 ELSE 25 END AS plen,
  1 + p {div} plen AS period, p % plen AS q,
  CASE WHEN period <= 4 THEN 600 - (600 {div} plen) * q ELSE 300 - 15 * q END AS sec,
  p {div} 10 AS sub_no,
  CASE WHEN p % 10 >= 8 THEN (sub_no + g) % 2 ELSE u % 2 END AS side,
  ((p + 1) {div} 10 + 1 - (g + side) % 2) {div} 2 AS swaps,
  CASE WHEN p % 10 = 8 THEN swaps % 10 WHEN p % 10 = 9 THEN (swaps + 4) % 10
       ELSE (swaps + (u {div} 2) % 5) % 10 END AS slot,
  CASE WHEN p % 10 = 8 THEN 'OUT' WHEN p % 10 = 9 THEN 'IN'
       WHEN q = 0 THEN 'BP' WHEN q = plen - 1 THEN 'EP'
       WHEN p % 7 = 3 THEN CASE WHEN k < 60 THEN '2FGM' ELSE '3FGM' END
       WHEN p % 7 = 4 AND k < 60 THEN 'AS'
       WHEN k < 12 THEN '2FGM' WHEN k < 24 THEN '2FGA' WHEN k < 30 THEN '3FGM' WHEN k < 40 THEN '3FGA'
       WHEN k < 48 THEN 'FTM' WHEN k < 52 THEN 'FTA' WHEN k < 60 THEN 'D' WHEN k < 65 THEN 'O'
       WHEN k < 71 THEN 'TO' WHEN k < 75 THEN 'ST' WHEN k < 79 THEN 'AS' WHEN k < 82 THEN 'FV'
       WHEN k < 84 THEN 'AG' WHEN k < 91 THEN 'CM' WHEN k < 93 THEN 'CMU' WHEN k < 97 THEN 'RV'
       WHEN k < 99 THEN 'TOUT' ELSE 'OF' END AS pt,
  CASE pt WHEN '2FGM' THEN 2 WHEN '3FGM' THEN 3 WHEN 'FTM' THEN 1 ELSE 0 END AS pts,
  CASE WHEN side = 0 THEN hi ELSE ai END AS club
"""

# Registered games also carry these; used by the schedule feed.
DAY_OFFSET = "r0 * 14 - (r0 % 3) * 10 + pair % 3"


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = PLAY_FIELDS.replace("{div}", "div").replace("{k}", "CAST(get_json_object(props, '$.k') AS INT)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql("SELECT " + fields + " FROM {events}", events=events)


def _code(idx: str):
    return F.expr(f"split_part('{CLUBS}', ',', CAST({idx} + 1 AS INT))")


def _player_id(club: str, slot: str):
    # Slot 9 changes clubs from the seventh round on: a mid-season transfer.
    moved = f"({club} + CASE WHEN {slot} = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18"
    return F.expr(f"'P' || lpad(CAST({moved} AS STRING), 2, '0') || lpad(CAST({slot} AS STRING), 2, '0')")


def _player_name(club: str, slot: str):
    moved = f"({club} + CASE WHEN {slot} = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18"
    surnames, given = SURNAMES.replace("'", "\\'"), GIVEN
    return F.expr(
        f"split_part('{surnames}', ',', CAST({slot} + 1 AS INT)) || ', ' || "
        f"split_part('{given}', ',', CAST(({moved}) % 9 + 1 AS INT))"
    )


def raw_play_by_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw play-by-play; scores sit in POINTS_A/B, or only in COMMENT for every third game."""
    order = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ev = plays(spark, sf_dir)
    scored = (
        ev.withColumn("sa", F.sum(F.expr("CASE WHEN side = 0 THEN pts ELSE 0 END")).over(order))
        .withColumn("sb", F.sum(F.expr("CASE WHEN side = 1 THEN pts ELSE 0 END")).over(order))
    )
    no_team, no_player = "pt IN ('BP', 'EP')", "pt IN ('BP', 'EP', 'TOUT')"
    visible = "pts > 0 AND g % 3 <> 0"
    mmss = "lpad(CAST(sec div 60 AS STRING), 2, '0') || ':' || lpad(CAST(sec % 60 AS STRING), 2, '0')"
    return scored.select(
        F.expr("CAST(2024 + sn AS INT)").alias("Season"), F.expr("CAST(gi + 1 AS INT)").alias("Gamecode"),
        F.col("pt").alias("PLAYTYPE"),
        F.when(F.expr(no_player), "").otherwise(F.concat(_player_id("club", "slot"), F.lit("   "))).alias("PLAYER_ID"),
        F.when(F.expr(no_player), "").otherwise(_player_name("club", "slot")).alias("PLAYER"),
        F.when(F.expr(no_team), "").otherwise(_code("club")).alias("CODETEAM"),
        F.expr("CAST(period AS INT)").alias("PERIOD"),
        F.expr("CAST((period - 1) * 10 + (600 - sec) div 60 + 1 AS INT)").alias("MINUTE"),
        F.expr(f"CASE WHEN pt = 'TOUT' THEN '' ELSE {mmss} END").alias("MARKERTIME"),
        F.expr("CAST(p + 1 AS INT)").alias("NUMBEROFPLAY"), F.expr("CAST(p + 1 AS INT)").alias("TRUE_NUMBEROFPLAY"),
        F.expr(f"CASE WHEN {visible} THEN CAST(sa AS DOUBLE) END").alias("POINTS_A"),
        F.expr(f"CASE WHEN {visible} THEN CAST(sb AS DOUBLE) END").alias("POINTS_B"),
        F.expr("CASE WHEN pts > 0 AND g % 3 = 0 THEN 'Score (' || sa || '-' || sb || ')' ELSE '' END").alias("COMMENT"),
        F.expr("event_id").alias("EVENT_ID"), F.col("ts").alias("TS"),
    )


def _game_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays(spark, sf_dir).groupBy("g", "sn", "gi", "r0", "pair", "hi", "ai").agg(
        F.expr("sum(CASE WHEN side = 0 THEN pts ELSE 0 END)").alias("home_pts"),
        F.expr("sum(CASE WHEN side = 1 THEN pts ELSE 0 END)").alias("away_pts"),
    )


_BOX_COUNTS = {
    "fgm2": ["2FGM"], "fga2": ["2FGM", "2FGA"], "fgm3": ["3FGM"], "fga3": ["3FGM", "3FGA"],
    "ftm": ["FTM"], "fta": ["FTM", "FTA"], "orb": ["O"], "drb": ["D"], "ast": ["AS"], "stl": ["ST"],
    "tov": ["TO"], "blk": ["FV"], "blka": ["AG"], "pf": ["CM", "CMU", "OF"], "fr": ["RV"],
}


def raw_boxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw boxscore: 12 players a side plus the feed's 'Team' and 'Total' summary rows."""
    ev = plays(spark, sf_dir)
    counts = ev.groupBy("g", "side", "slot").agg(
        F.sum("pts").alias("points"),
        *[F.count_if(F.col("pt").isin(codes)).alias(n) for n, codes in _BOX_COUNTS.items()],
    )
    games = ev.select("g", "sn", "gi", "r0", "hi", "ai").distinct()
    roster = (
        games.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(13))))
        .withColumn("club", F.expr("CASE WHEN side = 0 THEN hi ELSE ai END"))
    )
    rows = roster.join(counts, ["g", "side", "slot"], "left").withColumn(
        "secs", F.expr("300 + (slot * 419 + g * 37) % 1500")
    )
    stat = lambda n: F.expr(f"CAST(coalesce({n}, 0) AS INT)")
    return rows.select(
        F.expr("CAST(2024 + sn AS INT)").alias("Season"), F.expr("CAST(gi + 1 AS INT)").alias("Gamecode"),
        F.expr("1 - side").alias("Home"),
        F.when(F.expr("slot = 12"), "Team").when(F.expr("slot = 13"), "Total")
        .otherwise(F.concat(_player_id("club", "slot"), F.lit("   "))).alias("Player_ID"),
        F.expr("CASE WHEN slot < 5 THEN 1 ELSE 0 END").alias("IsStarter"),
        F.expr("CASE WHEN slot < 10 THEN 1 ELSE 0 END").alias("IsPlaying"),
        _code("club").alias("Team"), F.expr("CAST(slot + 4 AS STRING)").alias("Dorsal"),
        F.when(F.expr("slot >= 12"), "").otherwise(_player_name("club", "slot")).alias("Player"),
        F.expr(
            "CASE WHEN slot < 10 THEN lpad(CAST(secs div 60 AS STRING), 2, '0') || ':' || "
            "lpad(CAST(secs % 60 AS STRING), 2, '0') ELSE 'DNP' END"
        ).alias("Minutes"),
        stat("points").alias("Points"), stat("fgm2").alias("FieldGoalsMade2"), stat("fga2").alias("FieldGoalsAttempted2"),
        stat("fgm3").alias("FieldGoalsMade3"), stat("fga3").alias("FieldGoalsAttempted3"),
        stat("ftm").alias("FreeThrowsMade"), stat("fta").alias("FreeThrowsAttempted"),
        stat("orb").alias("OffensiveRebounds"), stat("drb").alias("DefensiveRebounds"),
        F.expr("CAST(coalesce(orb, 0) + coalesce(drb, 0) AS INT)").alias("TotalRebounds"),
        stat("ast").alias("Assistances"), stat("stl").alias("Steals"), stat("tov").alias("Turnovers"),
        stat("blk").alias("BlocksFavour"), stat("blka").alias("BlocksAgainst"),
        stat("pf").alias("FoulsCommited"), stat("fr").alias("FoulsReceived"),
        F.expr("CAST(coalesce(points, 0) + coalesce(orb, 0) + coalesce(drb, 0) + coalesce(ast, 0) - coalesce(tov, 0) AS INT)").alias("Valuation"),
        F.expr("CAST((g * 7 + slot * 3) % 41 - 20 AS DOUBLE)").alias("Plusminus"),
    )


def raw_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ev = (
        plays(spark, sf_dir)
        .withColumn("sa", F.sum(F.expr("CASE WHEN side = 0 THEN pts ELSE 0 END")).over(order))
        .withColumn("sb", F.sum(F.expr("CASE WHEN side = 1 THEN pts ELSE 0 END")).over(order))
        .filter(F.col("pt").isin("2FGM", "2FGA", "3FGM", "3FGA", "FTM", "FTA"))
    )
    field_goal = "pt NOT IN ('FTM', 'FTA')"
    return ev.select(
        F.expr("CAST(2024 + sn AS INT)").alias("Season"), F.expr("CAST(gi + 1 AS INT)").alias("Gamecode"),
        F.expr("CAST(p + 1 AS INT)").alias("NUM_ANOT"), _code("club").alias("TEAM"),
        F.concat(_player_id("club", "slot"), F.lit("   ")).alias("ID_PLAYER"), _player_name("club", "slot").alias("PLAYER"),
        F.col("pt").alias("ID_ACTION"),
        F.expr("CASE WHEN pts > 0 THEN 'Made ' ELSE 'Missed ' END || substring(pt, 1, 1)").alias("ACTION"),
        F.expr("CAST(pts AS INT)").alias("POINTS"),
        F.expr(f"CASE WHEN {field_goal} AND k % 17 <> 1 THEN CAST((u * 37 + k * 11 + p * 5) % 1401 - 700 AS DOUBLE) END").alias("COORD_X"),
        F.expr(f"CASE WHEN {field_goal} AND k % 17 <> 1 THEN CAST((u * 13 + k * 29) % 1000 - 50 AS DOUBLE) END").alias("COORD_Y"),
        F.expr(f"CASE WHEN {field_goal} THEN substring('ABCDEFGHIJ', CAST(k % 10 + 1 AS INT), 1) ELSE ' ' END").alias("ZONE"),
        F.expr("CAST(k % 2 AS STRING)").alias("FASTBREAK"), F.expr("CAST(u % 2 AS STRING)").alias("SECOND_CHANCE"),
        F.expr("CASE WHEN k % 3 = 0 THEN '1' ELSE '' END").alias("POINTS_OFF_TURNOVER"),
        F.expr("CAST((period - 1) * 10 + (600 - sec) div 60 + 1 AS INT)").alias("MINUTE"),
        F.expr("lpad(CAST(sec div 60 AS STRING), 2, '0') || ':' || lpad(CAST(sec % 60 AS STRING), 2, '0')").alias("CONSOLE"),
        F.expr("CAST(sa AS INT)").alias("POINTS_A"), F.expr("CAST(sb AS INT)").alias("POINTS_B"),
    )


def _date_text(day):
    return (
        F.when(F.expr("g % 11 = 5"), F.date_format(day, "yyyy-MM-dd"))
        .when(F.expr("g % 13 = 6"), F.date_format(day, "MMMM d, yyyy"))
        .otherwise(F.date_format(day, "MMM dd, yyyy"))
    )


def raw_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season list; every 25th game is under way (not played, no score yet)."""
    games = _game_rows(spark, sf_dir)
    day = F.expr(f"date_add(make_date(CAST(2024 + sn % 100 AS INT), 10, 1), CAST({DAY_OFFSET} AS INT))")
    live = "g % 25 = 24"
    return games.select(
        F.expr("CAST(2024 + sn AS INT)").alias("Season"), F.expr("CAST(r0 + 1 AS INT)").alias("Round"), F.lit("RS").alias("Phase"),
        F.expr("CAST(gi + 1 AS INT)").alias("gameCode"), F.expr(f"NOT ({live})").alias("played"),
        _code("hi").alias("homecode"), F.concat(F.lit("Club "), _code("hi")).alias("hometeam"),
        F.expr(f"CASE WHEN {live} THEN NULL ELSE CAST(home_pts AS STRING) END").alias("homescore"),
        _code("ai").alias("awaycode"), F.concat(F.lit("Club "), _code("ai")).alias("awayteam"),
        F.expr(f"CASE WHEN {live} THEN '-' ELSE CAST(away_pts AS STRING) END").alias("awayscore"),
        _date_text(day).alias("date"),
    )


def raw_extra_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-round feed with nested clubs: the return fixtures, dated far ahead; some wrongly flagged played."""
    games = _game_rows(spark, sf_dir)
    day = F.expr(f"date_add(make_date(2200, 1, 1), CAST({DAY_OFFSET} AS INT))")
    club = lambda idx: F.struct(
        _code(idx).alias("code"), F.concat(F.lit("Club "), _code(idx)).alias("name"),
        F.struct(F.concat(F.lit("crest/"), _code(idx)).alias("crest")).alias("images"),
    )
    return games.select(
        F.expr("CAST(2024 + sn AS INT)").alias("season"), F.expr("CAST(r0 + 18 + pair div 2 * 6 AS INT)").alias("round"),
        F.when(F.expr("pair = 8 AND r0 % 2 = 0"), "PO").otherwise("RS").alias("Phase"),
        F.expr("CAST(gi + 1001 AS INT)").alias("gameCode"), F.expr("pair < 3").alias("played"),
        F.struct(club("ai").alias("club"), F.expr("CASE WHEN pair < 3 THEN CAST(away_pts AS INT) END").alias("score")).alias("local"),
        F.struct(club("hi").alias("club"), F.expr("CASE WHEN pair < 3 THEN CAST(home_pts AS INT) END").alias("score")).alias("road"),
        F.date_format(day, "MMM dd, yyyy").alias("date"),
    )


def raw_game_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _game_rows(spark, sf_dir)
    ref = lambda step: F.expr(f"split_part('{REFEREES}', ',', CAST((g + {step}) % 7 + 1 AS INT))")
    return games.select(
        F.expr("CAST(2024 + sn AS INT)").alias("Season"), F.expr("CAST(gi + 1 AS INT)").alias("Gamecode"),
        F.expr("CAST(r0 + 1 AS INT)").alias("Round"), F.concat(F.lit("Arena "), _code("hi")).alias("Stadium"),
        _code("hi").alias("CodeTeamA"), _code("ai").alias("CodeTeamB"),
        F.expr("CAST(home_pts AS INT)").alias("ScoreA"), F.expr("CAST(away_pts AS INT)").alias("ScoreB"),
        F.concat(F.lit("Coach "), _code("hi")).alias("CoachA"), F.concat(F.lit("Coach "), _code("ai")).alias("CoachB"),
        ref(OFFICIAL_STEPS[0]).alias("Referee1"), F.concat(ref(OFFICIAL_STEPS[1]), F.lit(" ")).alias("Referee2"),
        F.when(F.expr("g % 6 = 1"), F.lit(None).cast("string")).otherwise(ref(OFFICIAL_STEPS[2])).alias("Referee3"),
        F.lit("RS").alias("Phase"),
    )


def raw_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster feed: one row per player with height, birthdate, position text and country."""
    ids = (
        plays(spark, sf_dir).select("hi", "ai", "r0").distinct()
        .withColumn("club", F.explode(F.array("hi", "ai")))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(11))))
        .select(F.expr("(club + CASE WHEN slot = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18").alias("t"), "slot")
        .distinct()
    )
    n = "(t * 12 + slot)"
    return ids.select(
        F.expr("'P' || lpad(CAST(t AS STRING), 2, '0') || lpad(CAST(slot AS STRING), 2, '0')").alias("player_id"),
        F.expr(
            f"split_part('{SURNAMES}', ',', CAST(slot + 1 AS INT)) || ', ' || ".replace("'DELL", "\\'DELL")
            + f"split_part('{GIVEN}', ',', CAST(t % 9 + 1 AS INT))"
        ).alias("player_name"),
        _code("t").alias("team_code"), F.expr("CAST(slot + 4 AS STRING)").alias("dorsal"),
        F.expr(f"CASE WHEN slot = 11 THEN NULL ELSE CAST(178 + ({n} * 37) % 45 AS INT) END").alias("height"),
        F.expr(f"CASE WHEN {n} % 23 = 5 THEN NULL ELSE date_add(DATE '1986-01-01', CAST(({n} * 149) % 7000 AS INT)) END").alias("birthdate"),
        F.expr(
            f"CASE slot % 3 WHEN 0 THEN CASE WHEN {n} % 2 = 0 THEN 'guard' ELSE 'G' END "
            "WHEN 1 THEN CASE WHEN t % 4 = 0 THEN 'forward-center' ELSE 'Forward' END ELSE 'Center' END"
        ).alias("position"),
        F.expr(f"split_part('{COUNTRIES}', ',', CAST({n} % 9 + 1 AS INT))").alias("country"),
    )


# -- season feeds, accumulated from the boxscores ------------------------------
_FEED_SUMS = {
    "pointsScored": "points", "twoPointersMade": "fgm2", "twoPointersAttempted": "fga2", "threePointersMade": "fgm3",
    "threePointersAttempted": "fga3", "freeThrowsMade": "ftm", "freeThrowsAttempted": "fta", "offensiveRebounds": "off_rebounds",
    "defensiveRebounds": "def_rebounds", "totalRebounds": "total_rebounds", "turnovers": "turnovers", "steals": "steals",
    "assists": "assists", "blocks": "blocks_favour", "foulsDrawn": "fouls_received",
}


def _tenths(num: str, den: str):
    """Percent text with one decimal, rounded in whole tenths: '54.2%'."""
    t = f"((2000 * ({num}) + ({den})) div (2 * ({den})))"
    return F.expr(f"CASE WHEN ({den}) > 0 THEN ({t} div 10) || '.' || ({t} % 10) || '%' END")


def team_feed(box: DataFrame, opponents: bool = False) -> DataFrame:
    """Accumulated team statistics, or what the team's opponents accumulated against it."""
    rows = box
    if opponents:
        sides = box.select("season", "gamecode", "team_code").distinct()
        other = sides.withColumnRenamed("team_code", "for_team")
        rows = box.join(other, ["season", "gamecode"]).filter("for_team <> team_code").drop("team_code").withColumnRenamed("for_team", "team_code")
    return rows.groupBy("season", "team_code").agg(
        F.countDistinct("gamecode").alias("gamesPlayed"), *[F.sum(c).alias(n) for n, c in _FEED_SUMS.items()]
    ).select(
        "season", F.struct(F.col("team_code").alias("code"), F.concat(F.lit("Club "), "team_code").alias("name")).alias("team"),
        "gamesPlayed", *_FEED_SUMS,
    )


def team_advanced_feed(box: DataFrame) -> DataFrame:
    fga = "twoPointersAttempted + threePointersAttempted"
    return team_feed(box).select(
        "season", "team", _tenths("2 * twoPointersMade", "pointsScored").alias("pointsFromTwoPointersPercentage"),
        _tenths("3 * threePointersMade", "pointsScored").alias("pointsFromThreePointersPercentage"),
        _tenths("freeThrowsMade", "pointsScored").alias("pointsFromFreeThrowsPercentage"),
        _tenths("2 * twoPointersMade + 3 * threePointersMade", f"2 * ({fga})").alias("effectiveFieldGoalPercentage"),
        _tenths("50 * pointsScored", f"100 * ({fga}) + 44 * freeThrowsAttempted").alias("trueShootingPercentage"),
    )


def _player_sums(box: DataFrame) -> DataFrame:
    return box.filter("seconds > 0").groupBy("season", "player_id").agg(
        F.max("team_code").alias("team_code"), F.max("player_name").alias("player_name"), F.count("*").alias("n"),
        F.sum("seconds").alias("seconds"), *[F.sum(c).alias(f) for f, c in _FEED_SUMS.items()],
    )


def player_feed(box: DataFrame) -> DataFrame:
    """Per-game player statistics as the season feed shows them (numbers as text)."""
    team = F.struct(F.col("team_code").alias("code"), F.concat(F.lit("Club "), "team_code").alias("name"))
    per_game = lambda c: F.expr(f"CAST({c} / n AS STRING)").alias(c)
    return _player_sums(box).select(
        "season", F.struct(F.col("player_id").alias("code"), F.col("player_name").alias("name"), team.alias("team")).alias("player"),
        F.col("n").cast("string").alias("gamesPlayed"), F.expr("CAST(seconds / n / 60 AS STRING)").alias("minutesPlayed"),
        *[per_game(c) for c in _FEED_SUMS],
    )


def player_advanced_feed(box: DataFrame) -> DataFrame:
    fga = "twoPointersAttempted + threePointersAttempted"
    return _player_sums(box).select(
        "season", F.struct(F.col("player_id").alias("code")).alias("player"),
        F.expr(f"CAST((100 * ({fga}) + 44 * freeThrowsAttempted - 100 * offensiveRebounds + 100 * turnovers) / 100 / n AS STRING)").alias("possesions"),
        _tenths("50 * pointsScored", f"100 * ({fga}) + 44 * freeThrowsAttempted").alias("trueShootingPercentage"),
        _tenths("assists", f"{fga} + turnovers + assists").alias("assistsRatio"),
        _tenths("offensiveRebounds", "totalRebounds").alias("offensiveReboundsPercentage"),
        _tenths("defensiveRebounds", "totalRebounds").alias("defensiveReboundsPercentage"),
        _tenths("threePointersAttempted", fga).alias("threePointAttemptsRatio"), _tenths("freeThrowsAttempted", fga).alias("freeThrowsRate"),
        F.expr("CASE WHEN turnovers > 0 THEN CAST(assists / turnovers AS STRING) ELSE '-' END").alias("assistsToTurnoversRatio"),
    )
