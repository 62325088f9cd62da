"""Ingest, cleaning, merge, ETL and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlake import config as C, schemas
from courtlake.plans.oracle_base import AS_OF, FUTURE_AS_OF, MONTH, PTS, STATS, display, ratio
from courtlake.plans.queries_sequences import _LIVE_SCORE, ACTIVE_RUN, RUN_HISTORY
from courtlake.plans.registry import joined_text, query, rounded
from courtlake.session import scratch_path
from courtlake.sources import clean as N, feeds as S, sinks as W

_G = "season, gamecode"
_day = lambda text: F.to_date(F.lit(text))


@query("s1_boxscore_ingest", f"SELECT {_G}, player_id, player_name, team_code, is_home, is_starter, is_playing, points FROM box")
def _(lg):
    return N.clean_boxscores(lg.raw("boxscore")).select(
        "season", "gamecode", "player_id", "player_name", "team_code", "is_home", "is_starter", "is_playing", "points")


@query("n1_clean_boxscores", f"SELECT {_G}, player_id, minutes_str, seconds, minutes, {STATS}, valuation, dorsal FROM box")
def _(lg):
    return N.clean_boxscores(lg.raw("boxscore")).select(
        "season", "gamecode", "player_id", "minutes_str", "seconds", "minutes", *C.COUNT_STATS, "valuation", "dorsal")


@query("s2_play_by_play_ingest", f"SELECT {_G}, true_numberofplay, playtype, player_id, codeteam, period FROM pbp")
def _(lg):
    return N.clean_play_by_play(lg.raw("play_by_play")).select("season", "gamecode", "true_numberofplay", "playtype", "player_id", "codeteam", "period")


@query("n2_clean_play_by_play", f"SELECT {_G}, true_numberofplay, player, markertime, clock_secs, points_a, points_b, comment FROM pbp")
def _(lg):
    return N.clean_play_by_play(lg.raw("play_by_play")).select(
        "season", "gamecode", "true_numberofplay", "player", "markertime", "clock_secs", "points_a", "points_b", "comment")


_SHOT = "season gamecode num_anot team id_player player id_action points coord_x coord_y zone".split()


@query("s3_shot_ingest", f"SELECT {', '.join(_SHOT)} FROM shots")
def _(lg):
    return N.clean_shots(lg.raw("shots")).select(*_SHOT)


_SHOT2 = "season gamecode num_anot action fastbreak second_chance pts_off_turnover minute console points_a points_b shot_value made".split()


@query("n3_clean_shots", f"SELECT {', '.join(_SHOT2)} FROM shots")
def _(lg):
    return N.clean_shots(lg.raw("shots")).select(*_SHOT2)


@query("s4_schedule_ingest", f"""
  SELECT {_G}, round, round_name, played, home_code, home_name, coalesce(h.logo_url, '') AS home_logo, home_score, away_code, away_name, coalesce(a.logo_url, '') AS away_logo, away_score
  FROM schedule LEFT JOIN logos h ON h.team_code = home_code LEFT JOIN logos a ON a.team_code = away_code""")
def _(lg):
    return S.season_schedule(lg.raw("schedule"), lg.logos).drop("date", "game_day", "month_index")


@query("n4_clean_schedule", f"SELECT {_G}, home_score, away_score, date, CAST(game_day AS VARCHAR) AS game_day, {MONTH} AS month_index FROM schedule")
def _(lg):
    return N.clean_schedule(lg.raw("schedule")).select(
        "season", "gamecode", "home_score", "away_score", "date", F.col("game_day").cast("string").alias("game_day"), "month_index")


_FULL = f"""SELECT {_G}, round, home_code, away_code, CASE WHEN NOT fut THEN home_score END AS home_score, CASE WHEN NOT fut THEN away_score END AS away_score, played AND NOT fut AS played
  FROM (SELECT *, played AND game_day > {FUTURE_AS_OF} AS fut FROM (
    SELECT season, gamecode, round, home_code, away_code, home_score, away_score, played, game_day FROM schedule
    UNION ALL SELECT season, gamecode, round, home_code, away_code, home_score, away_score, played, game_day FROM extra) WHERE round <= 38)"""


def _full(lg):
    return S.full_schedule(lg.schedule, lg.extra, _day("2150-01-01"))


@query("s5_full_schedule", _FULL)
def _(lg):
    return _full(lg).select("season", "gamecode", "round", "home_code", "away_code", "home_score", "away_score", "played")


@query("s6_extra_rounds", f"SELECT {_G}, round, played, home_code, home_name, home_score, away_code, away_name, away_score, home_logo, away_logo, date FROM extra")
def _(lg):
    return S.extra_rounds(lg.raw("extra_rounds")).drop("round_name", "game_day")


@query("s7_game_metadata", "SELECT * FROM metadata")
def _(lg):
    return S.game_metadata(lg.raw("game_metadata"))


_PF = """SELECT season, player_id, max(team_code) AS team_code, max(player_name) AS player_name, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS secs, CAST(sum(points) AS BIGINT) AS pts,
    CAST(sum(fga2) AS BIGINT) AS a2, CAST(sum(fga3) AS BIGINT) AS a3, CAST(sum(fta) AS BIGINT) AS fta, CAST(sum(off_rebounds) AS BIGINT) AS orb, CAST(sum(def_rebounds) AS BIGINT) AS drb,
    CAST(sum(total_rebounds) AS BIGINT) AS reb, CAST(sum(turnovers) AS BIGINT) AS tov, CAST(sum(steals) AS BIGINT) AS stl, CAST(sum(assists) AS BIGINT) AS ast,
    CAST(sum(blocks_favour) AS BIGINT) AS blk, CAST(sum(fouls_received) AS BIGINT) AS fd FROM box WHERE seconds > 0 GROUP BY 1, 2"""


def _pct(n: str, d: str) -> str:
    t = f"((2000 * ({n}) + ({d})) // (2 * ({d})))"
    return f"CASE WHEN ({d}) > 0 THEN CAST(({t} // 10) || '.' || ({t} % 10) AS DOUBLE) / 100e0 END"


@query("s8_season_feed_pool", f"""
  SELECT *, CASE WHEN big > 18 AND big > guard * 1.3e0 THEN 'Center' WHEN guard > 14 AND guard > big * 1.1e0 THEN 'Guard' ELSE 'Forward' END AS position FROM (
    SELECT *, (coalesce(orb_pct, 0) + coalesce(drb_pct, 0)) * 50 + blocks_pg * 10 AS big, coalesce(assist_ratio, 0) * 50 + coalesce(three_pt_rate, 0) * 50 AS guard FROM (
      SELECT season, player_id AS player_code, {display('player_name')} AS player_name, team_code, 'Club ' || team_code AS team_name, n AS games_played, secs / n / 60 AS minutes_pg, pts / n AS points_pg,
        {_pct('50 * pts', '100 * (a2 + a3) + 44 * fta')} AS ts_pct, {_pct('ast', 'a2 + a3 + tov + ast')} AS assist_ratio, {_pct('orb', 'reb')} AS orb_pct, {_pct('drb', 'reb')} AS drb_pct,
        {_pct('a3', 'a2 + a3')} AS three_pt_rate, {_pct('fta', 'a2 + a3')} AS ft_rate, CASE WHEN tov > 0 THEN ast / tov ELSE 0e0 END AS ast_tov_ratio, stl / n AS steals_pg, blk / n AS blocks_pg,
        CASE WHEN po > 0 THEN (((a2 / n + a3 / n) * 100 + fta / n * 44 + (tov / n + ast / n) * 100) + fd / n * 100) / 100e0 / po END AS true_usg_pct,
        CASE WHEN po > 0 THEN (stl / n + blk / n + drb / n) / po END AS stop_rate, reb / n AS rebounds_pg, ast / n AS assists_pg
      FROM (SELECT *, (100 * (a2 + a3) + 44 * fta - 100 * orb + 100 * tov) / 100 / n AS po FROM ({_PF})) WHERE n >= 5 AND secs / n / 60 >= 8))""".replace("SELECT *, CASE WHEN big", "SELECT * EXCLUDE (big, guard), CASE WHEN big", 1))
def _(lg):
    from courtlake.operators import league as T
    from courtlake.sources import adapter as A

    return T.feed_player_pool(A.player_feed(lg.box), A.player_advanced_feed(lg.box))


@query("s9_game_info", f"""
  SELECT {_G}, any_value(home_team) AS home_team, any_value(away_team) AS away_team,
    CASE WHEN count(*) FILTER (points_a > 0) > 0 THEN max_by(points_a, p) FILTER (points_a > 0) ELSE sum(CASE WHEN side = 0 THEN CASE playtype WHEN '2FGM' THEN 2 WHEN '3FGM' THEN 3 WHEN 'FTM' THEN 1 ELSE 0 END ELSE 0 END) END AS home_score,
    CASE WHEN count(*) FILTER (points_a > 0) > 0 THEN max_by(points_b, p) FILTER (points_a > 0) ELSE sum(CASE WHEN side = 1 THEN CASE playtype WHEN '2FGM' THEN 2 WHEN '3FGM' THEN 3 WHEN 'FTM' THEN 1 ELSE 0 END ELSE 0 END) END AS away_score,
    TRUE AS played FROM pbp GROUP BY 1, 2""")
def _(lg):
    return S.game_info(lg.box, lg.pbp)


@query("s10_team_season_extract", f"SELECT b.season, b.gamecode, player_id, team_code FROM box b JOIN games g USING (season, gamecode) WHERE played AND (home_team = 'FCB' OR away_team = 'FCB')")
def _(lg):
    return S.team_season_extract(lg.box, lg.games, "FCB").select("season", "gamecode", "player_id", "team_code")


@query("s11_todays_games", f"SELECT {_G}, home_team, away_team, played FROM games WHERE game_day = {AS_OF}")
def _(lg):
    return S.todays_games(lg.games, _day("2024-10-09")).select("season", "gamecode", "home_team", "away_team", "played")


@query("s11_live_games", f"SELECT {_G}, home_team, away_team FROM games WHERE game_day = {AS_OF} AND NOT played AND EXISTS (SELECT 1 FROM pbp WHERE pbp.season = games.season AND pbp.gamecode = games.gamecode)")
def _(lg):
    return S.live_games(lg.games, lg.pbp, _day("2024-10-09")).select("season", "gamecode", "home_team", "away_team")


@query("n5_player_dimension", "SELECT player_id, display_name, team_code, height, age, age_bracket, position_group, archetype, country FROM archetypes")
def _(lg):
    return N.player_dimension(lg.raw("players"), "2024-10-09").select(
        "player_id", "display_name", F.expr("team_code").alias("raw_code"), "height", "age", "age_bracket", "position_group", "archetype", "country"
    ).withColumn("team_code", _alias("raw_code")).drop("raw_code")


def _alias(c):
    from courtlake.functions.exprs import team_alias

    return team_alias(c)


# -- merges: stored table from one feed, updates from another -------------------
@query("s12_load_teams", """
  SELECT coalesce(t.team_code, b.team_code) AS team_code, CASE WHEN t.team_code IS NULL THEN b.team_code WHEN b.team_code IS NOT NULL AND t.team_name = t.team_code THEN b.team_code ELSE t.team_name END AS team_name,
    logo_url, CASE WHEN t.team_code IS NULL THEN 'inserted' WHEN b.team_code IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM teams t FULL JOIN (SELECT DISTINCT team_code FROM box) b ON b.team_code = t.team_code""")
def _(lg):
    return W.load_teams(lg.teams, lg.box)


_BARE = "SELECT DISTINCT team_code, team_code AS team_name, CAST(NULL AS VARCHAR) AS logo_url FROM box"


def _bare_teams(lg):
    return lg.box.select("team_code").distinct().select("team_code", F.col("team_code").alias("team_name"), F.lit(None).cast("string").alias("logo_url"))


@query("s13_load_teams_from_schedule", f"""
  SELECT coalesce(s.team_code, t.team_code) AS team_code, CASE WHEN s.team_code IS NULL THEN t.team_name ELSE coalesce(nullif(t.team_name, t.team_code), s.team_name) END AS team_name,
    coalesce(t.logo_url, s.logo_url) AS logo_url, CASE WHEN s.team_code IS NULL THEN 'inserted' WHEN t.team_code IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM ({_BARE}) s FULL JOIN teams t ON t.team_code = s.team_code""")
def _(lg):
    return W.load_teams_from_schedule(_bare_teams(lg), lg.teams)


@query("s13_update_teams_metadata", f"""
  SELECT s.team_code, coalesce(t.team_name, s.team_name) AS team_name, coalesce(t.logo_url, s.logo_url) AS logo_url, CASE WHEN t.team_code IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM ({_BARE}) s LEFT JOIN teams t ON t.team_code = s.team_code""")
def _(lg):
    return W.update_teams_metadata(_bare_teams(lg), lg.teams)


@query("s14_load_players", """
  SELECT coalesce(p.player_id, b.player_id) AS player_id, coalesce(b.player_name, p.player_name) AS player_name, coalesce(b.team_code, p.team_code) AS team_code, coalesce(b.dorsal, p.dorsal) AS dorsal,
    height, country, CASE WHEN p.player_id IS NULL THEN 'inserted' WHEN b.player_id IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM players p FULL JOIN (SELECT player_id, player_name, team_code, dorsal FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, gamecode, team_code) AS n FROM box) WHERE n = 1) b ON b.player_id = p.player_id""")
def _(lg):
    return W.load_players(lg.players, lg.box).drop("birthdate", "position")


_INFO = f"SELECT {_G}, any_value(home_team) AS home_team, any_value(away_team) AS away_team, max(points_a) AS hs, max(points_b) AS aws FROM pbp GROUP BY 1, 2"


@query("s15_load_games", f"""
  SELECT season, gamecode, coalesce(i.home_team, g.home_team) AS home_team, coalesce(i.away_team, g.away_team) AS away_team, coalesce(hs, home_score) AS home_score, coalesce(aws, away_score) AS away_score,
    game_date, round, CASE WHEN i.hs IS NULL THEN played ELSE TRUE END AS played, referee1, CASE WHEN g.round IS NULL THEN 'inserted' WHEN i.hs IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM games g FULL JOIN ({_INFO}) i USING (season, gamecode)""")
def _(lg):
    return W.load_games(lg.games, S.game_info(lg.box, lg.pbp)).select(
        "season", "gamecode", "home_team", "away_team", "home_score", "away_score", "game_date", "round", "played", "referee1", "change")


_SEED = f"""SELECT season, gamecode, coalesce(f.home_code, g.home_team) AS home_team, coalesce(f.away_code, g.away_team) AS away_team, coalesce(f.home_score, g.home_score) AS home_score,
    coalesce(f.away_score, g.away_score) AS away_score, coalesce(f.round, g.round) AS round, coalesce(g.played, FALSE) OR coalesce(f.played, FALSE) AS played,
    CASE WHEN g.home_team IS NULL THEN 'inserted' WHEN f.home_code IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM games g FULL JOIN ({_FULL}) f USING (season, gamecode)"""


def _seeded(lg):
    return W.seed_schedule(lg.games, _full(lg))


@query("s16_seed_schedule", _SEED)
def _(lg):
    return _seeded(lg).select("season", "gamecode", "home_team", "away_team", "home_score", "away_score", "round", "played", "change")


@query("s16_seed_counts", f"SELECT count(*) FILTER (change <> 'kept') AS total, count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated FROM ({_SEED})")
def _(lg):
    return W.merge_counts(_seeded(lg))


@query("s17_patch_games", f"""
  SELECT i.season, i.gamecode, i.home_team, CASE WHEN s.played THEN s.round END AS round, CASE WHEN s.played THEN s.date END AS game_date, coalesce(s.played, FALSE) AS played, CASE WHEN s.played THEN 'updated' ELSE 'kept' END AS change
  FROM ({_INFO}) i LEFT JOIN schedule s USING (season, gamecode)""")
def _(lg):
    stored = S.game_info(lg.box, lg.pbp).select(
        "season", "gamecode", "home_team", F.lit(None).cast("int").alias("round"), F.lit(None).cast("string").alias("game_date"), F.lit(False).alias("played"))
    return W.patch_games(stored, lg.schedule)


@query("s17_patch_referees", "SELECT s.season, s.gamecode, s.home_code, m.referee1, m.referee2, m.referee3, CASE WHEN m.season IS NULL THEN 'kept' ELSE 'updated' END AS change FROM schedule s LEFT JOIN metadata m USING (season, gamecode)")
def _(lg):
    none = [F.lit(None).cast("string").alias(f"referee{i}") for i in (1, 2, 3)]
    return W.patch_referees(lg.schedule.select("season", "gamecode", "home_code", *none), lg.metadata)


@query("s18_replace_games", f"""
  SELECT {_G}, true_numberofplay, 'stale' AS comment FROM pbp JOIN games USING (season, gamecode) WHERE NOT played
  UNION ALL SELECT {_G}, true_numberofplay, comment FROM pbp JOIN games USING (season, gamecode) WHERE played""")
def _(lg):
    stored = lg.pbp.withColumn("comment", F.lit("stale"))
    fresh = lg.pbp.join(lg.games.filter("played").select("season", "gamecode"), C.GAME_KEYS, "left_semi")
    return W.replace_games(stored, fresh).select("season", "gamecode", "true_numberofplay", "comment")


@query("s19_load_advanced_stats", f"""
  SELECT a.season, a.gamecode, a.player_id, a.points, CASE WHEN g.played THEN a.possessions END AS possessions, CASE WHEN g.played THEN 'updated' ELSE 'kept' END AS change
  FROM adv a JOIN games g USING (season, gamecode)""")
def _(lg):
    stored = lg.adv.withColumn("possessions", F.lit(None).cast("double"))
    fresh = lg.adv.join(lg.games.filter("played").select("season", "gamecode"), C.GAME_KEYS, "left_semi")
    return W.load_advanced_stats(stored, fresh).select("season", "gamecode", "player_id", "points", "possessions", "change")


@query("s19_load_on_off", "SELECT season, player_id, team, games, on_off_diff, 'inserted' AS change FROM season_onoff")
def _(lg):
    return W.load_on_off(lg.season_on_off.filter(F.lit(False)), lg.season_on_off).select("season", "player_id", "team", "games", "on_off_diff", "change")


@query("s20_missing_games", f"SELECT {_G} FROM extra WHERE played")
def _(lg):
    both = lg.schedule.select("season", "gamecode", "played").unionByName(lg.extra.select("season", "gamecode", "played"))
    return S.missing_games(both, lg.box)


# -- ETL: half of the games, then a second load that overlaps the first ----------
_SYNCED: dict[tuple, str] = {}


def _synced(lg):
    """The folder after both loads, once per application and data folder; reports are kept beside the tables."""
    from courtlake.plans.season import sync_games

    key = (lg.spark.sparkContext.applicationId, lg.state("events"))
    if key not in _SYNCED:
        root = scratch_path(lg.spark, "league")
        schedule = lg.schedule.withColumn("played", F.lit(True))  # by the time of these loads the running games are over
        for n, part in enumerate(("gamecode % 2 = 0", "gamecode % 2 = 1 OR gamecode % 4 = 0"), 1):
            feeds = [df.filter(part) for df in (lg.box, lg.pbp, lg.shots)]
            report = sync_games(lg.spark, root, *feeds, schedule, lg.metadata, lg.teams, lg.players)
            report.withColumn("sync", F.lit(n)).write.parquet(f"{root}/reports/n={n}")
        _SYNCED[key] = root
    return _SYNCED[key]


def _stored(lg, name):
    from courtlake.sources.store import Store

    return Store(lg.spark, _synced(lg)).read(name)


@query("s21_season_load", """
  SELECT 1 AS sync, season, count(*) AS total, count(*) FILTER (gamecode % 2 = 0) AS loaded, count(*) FILTER (gamecode % 2 = 1) AS failed FROM schedule GROUP BY season
  UNION ALL SELECT 2, season, count(*), count(*) FILTER (gamecode % 2 = 1), 0 FROM schedule GROUP BY season""")
def _(lg):
    return lg.spark.read.schema("season INT, total BIGINT, loaded BIGINT, failed BIGINT, sync INT").parquet(f"{_synced(lg)}/reports").select("sync", "season", "total", "loaded", "failed")


@query("s21_stored_boxscores", f"SELECT {_G}, player_id, player_name, team_code, is_starter, seconds, points, valuation FROM box")
def _(lg):
    return _stored(lg, "boxscores").select("season", "gamecode", "player_id", "player_name", "team_code", "is_starter", "seconds", "points", "valuation")


@query("s21_stored_plays", f"SELECT {_G}, true_numberofplay, playtype, player_id, clock_secs, points_a, points_b FROM pbp")
def _(lg):
    return _stored(lg, "play_by_play").select("season", "gamecode", "true_numberofplay", "playtype", "player_id", "clock_secs", "points_a", "points_b")


@query("s21_stored_shots", f"SELECT {_G}, num_anot, id_player, id_action, points, zone FROM shots")
def _(lg):
    return _stored(lg, "shots").select("season", "gamecode", "num_anot", "id_player", "id_action", "points", "zone")


@query("s21_stored_games", f"""
  SELECT season, gamecode, g.home_team, g.away_team, coalesce(hs, home_score) AS home_score, coalesce(aws, away_score) AS away_score, round, TRUE AS played, referee1
  FROM games g LEFT JOIN ({_INFO}) i USING (season, gamecode)""")
def _(lg):
    return _stored(lg, "games").select("season", "gamecode", "home_team", "away_team", "home_score", "away_score", "round", "played", "referee1")


@query("s21_stored_teams", "SELECT team_code, team_name, logo_url FROM teams")
def _(lg):
    return _stored(lg, "teams")


@query("s21_stored_players", """
  SELECT b.player_id, b.player_name, b.team_code, height, country FROM (
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY gamecode % 2 DESC, season, gamecode, team_code) AS n FROM box) b LEFT JOIN players p ON p.player_id = b.player_id WHERE n = 1""")
def _(lg):
    return _stored(lg, "players").select("player_id", "player_name", "team_code", "height", "country")


@query("s21_stored_advanced_stats", f"SELECT {_G}, player_id, points, round(possessions, 6) AS possessions, round(ts_pct, 6) AS ts_pct, round(off_rating, 6) AS off_rating FROM adv")
def _(lg):
    return rounded(_stored(lg, "player_advanced_stats").select("season", "gamecode", "player_id", "points", "possessions", "ts_pct", "off_rating"), "possessions", "ts_pct", "off_rating")


@query("s22_season_aggregation", "SELECT season, player_id, team, player_name, games, on_events, on_poss, on_net_rtg, off_net_rtg, on_off_diff FROM season_onoff")
def _(lg):
    return _stored(lg, "season_on_off_splits").select("season", "player_id", "team", "player_name", "games", "on_events", "on_poss", "on_net_rtg", "off_net_rtg", "on_off_diff")


# -- landed files: one per game and feed, some records broken, every ninth game absent, in two loads ----------
_FILED: dict[tuple, object] = {}
_ABSENT = "gamecode % 9 = 4"
#: Per feed: its raw schema, format, and which records are broken, in raw columns and in those of the statements.
_LANDING = {
    "boxscore": (schemas.RAW_BOXSCORE, "json", "Gamecode % 5 = 1 AND Home = 1 AND IsStarter = 1", "gamecode % 5 = 1 AND is_home = 1 AND is_starter = 1"),
    "play_by_play": (schemas.RAW_PLAY_BY_PLAY, "json", "Gamecode % 5 = 2 AND TRUE_NUMBEROFPLAY % 10 = 7", "gamecode % 5 = 2 AND true_numberofplay % 10 = 7"),
    "shots": (schemas.RAW_SHOTS, "csv", "Gamecode % 5 = 3 AND NUM_ANOT % 6 = 1", "gamecode % 5 = 3 AND num_anot % 6 = 1"),
}


def _landed(lg, feed):
    """The feed as files, read in two loads, once per application and state of the data."""
    from courtlake.sources import files
    from courtlake.sources.ingest import Landing

    key = (lg.spark.sparkContext.applicationId, lg.state("events"), feed)
    if key not in _FILED:
        schema, fmt, broken, _ = _LANDING[feed]
        folder, later, root = (scratch_path(lg.spark, f"{n}-{feed}") for n in ("landing", "later", "read"))
        names = [c.split()[0] for c in schema.split(", ")]
        raw = lg.raw(feed).select(*names).where(f"NOT ({_ABSENT})")
        line = F.to_json(F.struct(*names)) if fmt == "json" else F.to_csv(F.struct(*names))
        damaged = F.expr("substring(line, 1, length(line) - 9)") if fmt == "json" else F.concat(F.lit("?"), "line")
        lines = raw.select(F.col("Season").alias("s"), F.col("Gamecode").alias("g"), line.alias("line"), F.expr(broken).alias("broken"))
        lines = lines.select(F.expr("CAST(g % 2 AS INT)").alias("half"), "s", "g", F.when(F.col("broken"), damaged).otherwise(F.col("line")).alias("value"))
        put_lines(lines, later)  # the feed is derived once; its halves land one after the other
        landing = Landing(lg.spark, root, schema, fmt)
        for half in (0, 1):
            if files.exists(lg.spark, f"{later}/half={half}"):
                files.make_folder(lg.spark, folder)
                files.rename(lg.spark, f"{later}/half={half}", f"{folder}/half={half}")
            landing.load([f"{folder}/half=*/s=*", f"{folder}/half=0/s=1900/g=1"])
        _FILED[key] = landing
    return _FILED[key]


def put_lines(lines, folder):
    """Text files of ``half, s, g, value``, one a game, in folders by these names.

    Where the folder is on a file system that executors have in common, tasks write them directly: Spark's own writer starts processes for
    every file there and has the driver move each of them.
    """
    import os
    import uuid

    import numpy as np

    from courtlake.sources import files

    lines = lines.repartition("half", "s", "g").sortWithinPartitions("half", "s", "g")
    to = files.local(lines.sparkSession, folder)
    if to is None:
        lines.write.partitionBy("half", "s", "g").text(folder)
        return

    def write(batches):
        game, draft, out = None, None, None

        def end():
            if out:
                out.close()
                os.replace(draft, f"{os.path.dirname(draft)}/game.txt")  # whole or not at all, if a task is run again

        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            heads = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
            for lo, hi in zip(heads, [*heads[1:], len(keys)]):
                if game != (now := tuple(keys[lo].tolist())):
                    end()
                    game, draft = now, "{}/half={}/s={}/g={}/.{}".format(to, *now, uuid.uuid4().hex)
                    os.makedirs(os.path.dirname(draft), exist_ok=True)
                    out = open(draft, "wb")
                out.write("".join(f"{x}\n" for x in b.column(3).slice(lo, hi - lo).to_pylist()).encode())
        end()
        yield from ()

    lines.mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()


def _there(feed: str, columns: str, source: str) -> str:
    return f"SELECT {columns} FROM {source} WHERE NOT ({_ABSENT}) AND NOT ({_LANDING[feed][3]})"


@query("s1_landed_boxscores", _there("boxscore", f"{_G}, player_id, player_name, team_code, seconds, {STATS}", "box"))
def _(lg):
    return N.clean_boxscores(_landed(lg, "boxscore").rows()).select("season", "gamecode", "player_id", "player_name", "team_code", "seconds", *C.COUNT_STATS)


@query("s2_landed_plays", _there("play_by_play", f"{_G}, true_numberofplay, playtype, player_id, codeteam, clock_secs, points_a, points_b", "pbp"))
def _(lg):
    return N.clean_play_by_play(_landed(lg, "play_by_play").rows()).select("season", "gamecode", "true_numberofplay", "playtype", "player_id", "codeteam", "clock_secs", "points_a", "points_b")


@query("s3_landed_shots", _there("shots", ", ".join(_SHOT), "shots"))
def _(lg):
    return N.clean_shots(_landed(lg, "shots").rows()).select(*_SHOT)


@query("s1_quarantined_records", " UNION ALL ".join(
    f"SELECT '{feed}' AS feed, season, gamecode, 'unreadable record' AS reason, count(*) AS records FROM {source} WHERE NOT ({_ABSENT}) AND {_LANDING[feed][3]} GROUP BY season, gamecode"
    for feed, source in (("boxscore", "box"), ("play_by_play", "pbp"), ("shots", "shots"))))
def _(lg):
    from functools import reduce

    from pyspark.sql import DataFrame

    part = lambda name: F.regexp_extract("file", f"/{name}=([0-9]+)", 1).cast("int")
    each = [_landed(lg, feed).aside().select(F.lit(feed).alias("feed"), part("s").alias("season"), part("g").alias("gamecode"), "reason") for feed in _LANDING]
    return reduce(DataFrame.unionByName, each).groupBy("feed", "season", "gamecode", "reason").agg(F.count(F.lit(1)).alias("records"))


@query("s1_file_ledger", f"""SELECT feed, CASE WHEN gamecode % 2 = 0 THEN 1 ELSE 2 END AS load, count(*) AS n_files
  FROM (SELECT DISTINCT season, gamecode FROM pbp), (VALUES ('boxscore'), ('play_by_play'), ('shots')) AS x(feed) WHERE NOT ({_ABSENT}) GROUP BY 1, 2""")
def _(lg):
    from functools import reduce

    from pyspark.sql import DataFrame

    each = [_landed(lg, feed).ledger().groupBy("load").agg(F.count(F.lit(1)).alias("n_files")).select(F.lit(feed).alias("feed"), "load", "n_files") for feed in _LANDING]
    return reduce(DataFrame.unionByName, each)


# -- publishing: catalog tables of the current version, and a load that is turned away ----------
_PUBLISHED: dict[tuple, tuple[str, int]] = {}


def _published(lg):
    """The catalog database of the stored tables, and its version, once per application and state of the data."""
    from courtlake.sources.store import publish

    key = (lg.spark.sparkContext.applicationId, lg.state("events"))
    if key not in _PUBLISHED:
        name = f"courtlake_{len(_PUBLISHED)}"
        _PUBLISHED[key] = (name, publish(lg.spark, _synced(lg), name))
    return _PUBLISHED[key]


def _columns():
    """(table, place, column, type) of the declared schema, types as the catalog names them."""
    for name, ddl in schemas.TABLES.items():
        fields = [f.split() for f in ddl.split(", ")]
        fields = [f for f in fields if f[0] != "season"] + [f for f in fields if f[0] == "season"]  # the partition column is last
        for i, (column, kind) in enumerate(fields, 1):
            yield name, i, column, {"INT": "int", "BIGINT": "bigint", "STRING": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}[kind]


@query("s23_catalog_columns", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c}', '{k}', 2)" for t, i, c, k in _columns()) + ") AS x(table_name, place, column_name, data_type, version)")
def _(lg):
    name, version = _published(lg)
    rows = [(t, i, c.name, c.dataType, version) for t in schemas.TABLES for i, c in enumerate(lg.spark.catalog.listColumns(f"{name}.{t}"), 1)]
    return lg.spark.createDataFrame(rows, "table_name STRING, place INT, column_name STRING, data_type STRING, version INT")


_SEASON_ROWS = {"games": "games", "play_by_play": "pbp", "boxscores": "box", "player_advanced_stats": "adv", "shots": "shots", "season_on_off_splits": "season_onoff"}


@query("s23_catalog_rows", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, season, count(*) AS n_rows FROM {r} GROUP BY season" for t, r in _SEASON_ROWS.items()]
    + ["SELECT 'teams', NULL, count(*) FROM teams", "SELECT 'players', NULL, count(DISTINCT player_id) FROM box"]))
def _(lg):
    from functools import reduce

    from pyspark.sql import DataFrame

    name, _ = _published(lg)
    table = lambda t: lg.spark.table(f"{name}.{t}")
    parts = [table(t).groupBy("season").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "season", "n_rows") for t in _SEASON_ROWS]
    parts += [table(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), F.lit(None).cast("int").alias("season"), "n_rows") for t in ("teams", "players")]
    return reduce(DataFrame.unionByName, parts)


#: Faults of a load: what is wrong in which games.
_FAULTS = {
    ("boxscores", "key is not unique"): ("box", "gamecode % 7 = 0"), ("boxscores", "player_id is null"): ("box", "gamecode % 7 = 1 AND is_home = 1"),
    ("boxscores", "team_code not in teams"): ("box", "gamecode % 7 = 3 AND is_home = 0"), ("boxscores", "points is null"): ("box", "gamecode % 7 = 4 AND is_starter = 1"),
    ("play_by_play", "season, gamecode not in games"): ("pbp", "gamecode % 7 = 2"), ("play_by_play", "period is null"): ("pbp", "gamecode % 7 = 5"),
    ("shots", "key is not unique"): ("shots", "gamecode % 7 = 6"),
}
_COUNTED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) AS violations, 2 AS version FROM {src} WHERE {where}" for (t, r), (src, where) in _FAULTS.items())


@query("s23_rejected_load", f"SELECT * FROM ({_COUNTED}) WHERE violations > 0")
def _(lg):
    """What a load with these faults is turned away for, and the version that stays."""
    from courtlake.sources.constraints import ConstraintError
    from courtlake.sources.store import Store

    at = {k: F.expr(where) for k, (_, where) in _FAULTS.items()}
    damage = lambda c, key, value: F.when(at[key], value).otherwise(F.col(c)).alias(c)
    swap = lambda df, **new: df.select(*[new.get(c, F.col(c)) for c in df.columns])
    none = F.lit(None)
    box = swap(lg.box, player_id=damage("player_id", ("boxscores", "player_id is null"), none), points=damage("points", ("boxscores", "points is null"), none),
               team_code=damage("team_code", ("boxscores", "team_code not in teams"), F.lit("???")))
    pbp = swap(lg.pbp, gamecode=damage("gamecode", ("play_by_play", "season, gamecode not in games"), F.col("gamecode") + 100_000), period=damage("period", ("play_by_play", "period is null"), none))
    store = Store(lg.spark, _synced(lg))
    store.stage("boxscores", box.unionByName(lg.box.where(at["boxscores", "key is not unique"])))
    store.stage("play_by_play", pbp)
    store.stage("shots", lg.shots.unionByName(lg.shots.where(at["shots", "key is not unique"])))
    try:
        store.commit()
        found = []
    except ConstraintError as e:
        found = e.found
    version = Store(lg.spark, _synced(lg)).version
    return lg.spark.createDataFrame([(*f, version) for f in found], "table_name STRING, rule STRING, violations LONG, version INT")


# -- streams: overlapping slices of every game, the last plays first, one slice a micro-batch --
_LANDED: dict[tuple, str] = {}
_SLICES = ("TRUE_NUMBEROFPLAY > 60", "TRUE_NUMBEROFPLAY BETWEEN 20 AND 70", "TRUE_NUMBEROFPLAY <= 30 OR TRUE_NUMBEROFPLAY > 90", "TRUE_NUMBEROFPLAY % 10 = 0")
_REST = ("current_lineups", "active_run", "run_history", "momentum", "win_probability", "players")


def _streamed(lg, *tables):
    """The folder of the live tables after all slices, once per application, state of the data and choice of tables."""
    from courtlake.streaming import live as R

    key = (lg.spark.sparkContext.applicationId, lg.state("events"), tables)
    if key not in _LANDED:
        landing, out, checkpoint = (scratch_path(lg.spark, n) for n in ("landing", "live", "live-checkpoint"))
        whole = scratch_path(lg.spark, "raw-plays")
        lg.raw("play_by_play").write.parquet(whole)
        raw = lg.spark.read.parquet(whole)
        for part in _SLICES:
            raw.filter(part).repartition("Season", "Gamecode").write.mode("append").parquet(landing)
            R.write_live_games(R.play_stream(lg.spark, landing), lg.box, out, checkpoint, tables).awaitTermination()
        _LANDED[key] = out
    return R, _LANDED[key]


@query("r1_live_plays", f"SELECT {_G}, true_numberofplay, playtype, player_id, points_a, points_b FROM pbp")
def _(lg):
    R, out = _streamed(lg, "scores")
    return R.stored_plays(lg.spark, out).select("season", "gamecode", "true_numberofplay", "playtype", "player_id", "points_a", "points_b")


@query("r2_live_scores", _LIVE_SCORE)
def _(lg):
    R, out = _streamed(lg, "scores")
    return R.latest_table(lg.spark, out, "scores")


@query("r3_live_lineups", f"SELECT {_G}, team, array_to_string(max_by(lineup, p), ',') AS lineup FROM sided GROUP BY 1, 2, 3")
def _(lg):
    R, out = _streamed(lg, *_REST)
    return joined_text(R.latest_table(lg.spark, out, "current_lineups").select("season", "gamecode", "team", "lineup"), "lineup")


@query("r3_live_win_probability", f"""
  SELECT {_G}, play_number, home_score, away_score, round(greatest(0.001e0, least(0.999e0, 1 / (1 + exp(-0.15e0 * ((home_score - away_score + 3 * f) / greatest(sqrt(f), 0.1e0)))))), 9) AS home_wp
  FROM (SELECT {_G}, true_numberofplay AS play_number, points_a AS home_score, points_b AS away_score,
    greatest(greatest(CASE WHEN period <= 4 THEN 2400 - ((period - 1) * 600 + 600 - clock_secs) ELSE clock_secs END, 0) / 2400e0, 0.01e0) AS f FROM pbp WHERE playtype IN ('2FGM', '3FGM', 'FTM'))""")
def _(lg):
    R, out = _streamed(lg, *_REST)
    df = R.latest_table(lg.spark, out, "win_probability").select("season", "gamecode", "play_number", "home_score", "away_score", "home_wp")
    return df.withColumn("home_wp", F.round("home_wp", 9))


@query("r3_momentum", f"""
  SELECT {_G}, true_numberofplay AS play_number, points_a - points_b AS margin FROM pbp WHERE playtype IN ('2FGM', '3FGM', 'FTM')""")
def _(lg):
    R, out = _streamed(lg, *_REST)
    return R.latest_table(lg.spark, out, "momentum").select("season", "gamecode", "play_number", F.col("score_diff").alias("margin"))


@query("r3_active_run", ACTIVE_RUN)
def _(lg):
    R, out = _streamed(lg, *_REST)
    return R.latest_table(lg.spark, out, "active_run")


@query("l8b_live_run_log", RUN_HISTORY)
def _(lg):
    R, out = _streamed(lg, *_REST)
    return R.latest_table(lg.spark, out, "run_history")


#: The boxscore of the plays alone: counts, and time from each IN (or the start) to the player's next substitution or the last play.
_LIVE_BOX = f"""
  SELECT {_G}, player_id, player_name, team_code, seconds, points, total_rebounds, seconds / 60e0 AS minutes, assists, fga2 + fga3 AS fga, fta, off_rebounds, turnovers
  FROM (WITH t AS (SELECT *, CASE WHEN period <= 4 THEN period * 600 - clock_secs ELSE 2400 + (period - 4) * 300 - clock_secs END AS el FROM pbp),
    ends AS (SELECT season, gamecode, max(el) FILTER (markertime <> '') AS now FROM t GROUP BY 1, 2),
    subs AS (SELECT season, gamecode, codeteam, player_id, playtype, el, lead(el) OVER w AS following, row_number() OVER w AS n
      FROM t WHERE playtype IN ('IN', 'OUT') AND player_id IS NOT NULL WINDOW w AS (PARTITION BY season, gamecode, codeteam, player_id ORDER BY p)),
    spent AS (SELECT season, gamecode, codeteam, player_id, CAST(sum(CASE WHEN playtype = 'IN' THEN coalesce(following, now) - el WHEN n = 1 THEN el ELSE 0 END) AS BIGINT) AS secs
      FROM subs JOIN ends USING (season, gamecode) GROUP BY 1, 2, 3, 4)
    SELECT season, gamecode, t.player_id, max(player) AS player_name, t.codeteam AS team_code, greatest(coalesce(any_value(secs), any_value(now)), 0) AS seconds,
      CAST(sum({PTS}) AS BIGINT) AS points, count(*) FILTER (t.playtype IN ('O', 'D')) AS total_rebounds, count(*) FILTER (t.playtype = 'AS') AS assists,
      count(*) FILTER (t.playtype IN ('2FGM', '2FGA')) AS fga2, count(*) FILTER (t.playtype IN ('3FGM', '3FGA')) AS fga3, count(*) FILTER (t.playtype IN ('FTM', 'FTA')) AS fta,
      count(*) FILTER (t.playtype = 'O') AS off_rebounds, count(*) FILTER (t.playtype = 'TO') AS turnovers
    FROM t JOIN ends USING (season, gamecode) LEFT JOIN spent USING (season, gamecode, codeteam, player_id) WHERE t.player_id IS NOT NULL GROUP BY season, gamecode, t.codeteam, t.player_id)"""


@query("r4_live_players", f"""
  SELECT b.season, b.gamecode, player_id, player_name, b.team_code, minutes, points, total_rebounds, assists, {ratio('points * 50', 'fga * 100 + fta * 44')} AS ts_pct,
    CASE WHEN team_poss * share > 0 THEN points / (team_poss * share) * 100 END AS off_rating, CASE WHEN team_poss > 0 THEN opp / team_poss * 100 END AS def_rating
  FROM (SELECT *, CASE WHEN team_seconds > 0 THEN CAST(seconds AS DOUBLE) / team_seconds ELSE 0e0 END AS share
    FROM (SELECT * FROM ({_LIVE_BOX})) x JOIN (
      SELECT a.season AS s, a.gamecode AS g, a.team_code AS tc, a.team_poss, a.team_seconds, o.team_points AS opp FROM ({{team}}) a LEFT JOIN ({{team}}) o ON a.season = o.season AND a.gamecode = o.gamecode AND a.team_code <> o.team_code
    ) y ON x.season = s AND x.gamecode = g AND x.team_code = tc) b
  WHERE seconds > 0""".replace("{team}", f"""SELECT {_G}, team_code, (sum(fga) * 100 + sum(fta) * 44 - sum(off_rebounds) * 100 + sum(turnovers) * 100) / 100e0 AS team_poss,
      CAST(sum(seconds) AS BIGINT) AS team_seconds, CAST(sum(points) AS BIGINT) AS team_points FROM ({_LIVE_BOX}) GROUP BY 1, 2, 3"""))
def _(lg):
    R, out = _streamed(lg, *_REST)
    return R.latest_table(lg.spark, out, "players")
