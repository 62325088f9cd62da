"""Declared schemas of the raw feeds and of the stored league tables, as DDL text."""

from pyspark.sql.types import StructType

from courtlake import config as C


def struct(table: str) -> StructType:
    """The stored table's schema as a struct (needs a running session)."""
    return StructType.fromDDL(TABLES[table])


_BOX_INTS = [
    "Points", "FieldGoalsMade2", "FieldGoalsAttempted2", "FieldGoalsMade3", "FieldGoalsAttempted3",
    "FreeThrowsMade", "FreeThrowsAttempted", "OffensiveRebounds", "DefensiveRebounds", "TotalRebounds",
    "Assistances", "Steals", "Turnovers", "BlocksFavour", "BlocksAgainst", "FoulsCommited", "FoulsReceived",
    "Valuation",
]

RAW_BOXSCORE = (
    "Season INT, Gamecode INT, Home INT, Player_ID STRING, IsStarter INT, IsPlaying INT, Team STRING, "
    "Dorsal STRING, Player STRING, Minutes STRING, " + ", ".join(f"{c} INT" for c in _BOX_INTS) + ", Plusminus DOUBLE"
)
RAW_PLAY_BY_PLAY = (
    "Season INT, Gamecode INT, PLAYTYPE STRING, PLAYER_ID STRING, PLAYER STRING, CODETEAM STRING, PERIOD INT, "
    "MINUTE INT, MARKERTIME STRING, NUMBEROFPLAY INT, TRUE_NUMBEROFPLAY INT, POINTS_A DOUBLE, POINTS_B DOUBLE, "
    "COMMENT STRING, EVENT_ID BIGINT, TS TIMESTAMP"
)
RAW_SHOTS = (
    "Season INT, Gamecode INT, NUM_ANOT INT, TEAM STRING, ID_PLAYER STRING, PLAYER STRING, ID_ACTION STRING, "
    "ACTION STRING, POINTS INT, COORD_X DOUBLE, COORD_Y DOUBLE, ZONE STRING, FASTBREAK STRING, SECOND_CHANCE STRING, "
    "POINTS_OFF_TURNOVER STRING, MINUTE INT, CONSOLE STRING, POINTS_A INT, POINTS_B INT"
)
RAW_SCHEDULE = (
    "Season INT, Round INT, Phase STRING, gameCode INT, played BOOLEAN, homecode STRING, hometeam STRING, "
    "homescore STRING, awaycode STRING, awayteam STRING, awayscore STRING, date STRING"
)
RAW_EXTRA_ROUNDS = (
    "season INT, round INT, Phase STRING, gameCode INT, played BOOLEAN, "
    "local STRUCT<club: STRUCT<code: STRING, name: STRING, images: STRUCT<crest: STRING>>, score: INT>, "
    "road STRUCT<club: STRUCT<code: STRING, name: STRING, images: STRUCT<crest: STRING>>, score: INT>, date STRING"
)
RAW_METADATA = (
    "Season INT, Gamecode INT, Round INT, Stadium STRING, CodeTeamA STRING, CodeTeamB STRING, ScoreA INT, ScoreB INT, "
    "CoachA STRING, CoachB STRING, Referee1 STRING, Referee2 STRING, Referee3 STRING, Phase STRING"
)

_STATS_INT = ", ".join(f"{c} INT" for c in C.COUNT_STATS)
TABLES = {
    "teams": "team_code STRING, team_name STRING, logo_url STRING",
    "players": (
        "player_id STRING, player_name STRING, team_code STRING, dorsal STRING, height INT, birthdate DATE, "
        "position STRING, country STRING"
    ),
    "games": (
        "season INT, gamecode INT, home_team STRING, away_team STRING, home_score INT, away_score INT, "
        "game_date STRING, game_day DATE, round INT, played BOOLEAN, referee1 STRING, referee2 STRING, referee3 STRING"
    ),
    "play_by_play": (
        "season INT, gamecode INT, period INT, playtype STRING, player_id STRING, player STRING, codeteam STRING, "
        "markertime STRING, clock_secs INT, numberofplay INT, true_numberofplay INT, points_a INT, points_b INT, comment STRING"
    ),
    "boxscores": (
        "season INT, gamecode INT, player_id STRING, player_name STRING, team_code STRING, is_home INT, is_starter INT, "
        f"is_playing INT, dorsal STRING, minutes_str STRING, seconds INT, minutes DOUBLE, {_STATS_INT}, valuation INT"
    ),
    "player_advanced_stats": (
        "season INT, gamecode INT, player_id STRING, player_name STRING, team_code STRING, is_home INT, seconds INT, "
        f"minutes DOUBLE, {_STATS_INT}, possessions DOUBLE, ts_pct DOUBLE, off_rating DOUBLE, def_rating DOUBLE, "
        "true_usg_pct DOUBLE, stop_rate DOUBLE"
    ),
    "shots": (
        "season INT, gamecode INT, num_anot INT, team STRING, id_player STRING, player STRING, id_action STRING, "
        "action STRING, points INT, coord_x DOUBLE, coord_y DOUBLE, zone STRING, fastbreak INT, second_chance INT, "
        "pts_off_turnover INT, minute INT, console STRING, points_a INT, points_b INT"
    ),
    "season_on_off_splits": (
        "season INT, player_id STRING, player_name STRING, team STRING, games BIGINT, "
        + ", ".join(
            f"{s}_events BIGINT, {s}_pts_for BIGINT, {s}_pts_against BIGINT, {s}_poss DOUBLE, {s}_ortg DOUBLE, "
            f"{s}_drtg DOUBLE, {s}_net_rtg DOUBLE"
            for s in ("on", "off")
        )
        + ", on_off_diff DOUBLE"
    ),
}
