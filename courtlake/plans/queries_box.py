"""Box-score, leaderboard and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlake import config as C
from courtlake.operators import box as B, filters as FL, quality as Q, ranking as O, windows as W
from courtlake.plans.oracle_base import STATS, display, ratio, ratio0
from courtlake.plans.registry import query, rounded

_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query("b1_team_possessions", "SELECT * FROM team_poss")
def _(lg):
    return B.team_possessions(lg.box)


@query("b2_advanced_stats", "SELECT * FROM adv")
def _(lg):
    return lg.adv


@query("b3_defensive_ratings", "SELECT season, gamecode, team_code, team_poss, team_points, opp_points, def_rating FROM team_drtg")
def _(lg):
    return B.defensive_ratings(B.team_possessions(lg.box))


_SUMS = [c for c in B.SEASON_SUMS if c not in ("minutes", "possessions")]
_USED = "((fga2 + fga3) * 100 + fta * 44 + (turnovers + assists) * 100 + fouls_received * 100)"


@query("b4_season_player_stats", f"""
  SELECT season, team_code, player_id, player_name, seconds, {', '.join(_SUMS)}, minutes, {_R('possessions')}, ts_pct,
    round(CASE WHEN possessions > 0 THEN {_USED} / 100e0 / possessions END, 6) AS true_usg_pct,
    round(CASE WHEN possessions > 0 THEN (steals + blocks_favour + def_rebounds) / possessions END, 6) AS stop_rate,
    round(CASE WHEN possessions > 0 THEN points / possessions * 100 END, 6) AS off_rating
  FROM (SELECT *, seconds / 60e0 AS minutes, {ratio('points * 50', '(fga2 + fga3) * 100 + fta * 44')} AS ts_pct
    FROM (SELECT season, team_code, player_id, min_by(player_name, gamecode) AS player_name, CAST(sum(seconds) AS BIGINT) AS seconds,
            {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, sum(possessions) AS possessions
          FROM adv GROUP BY 1, 2, 3)) WHERE seconds > 0""")
def _(lg):
    return rounded(B.season_player_stats(lg.adv), "possessions", "true_usg_pct", "stop_rate", "off_rating")


_AVG5 = ["avg_points", "avg_ts_pct", "avg_off_rating", "avg_def_rating", "avg_possessions"]


@query("b5_team_averages", """
  SELECT season, team_code, count(DISTINCT gamecode) AS games_played, round(avg(points), 6) AS avg_points, round(avg(ts_pct), 6) AS avg_ts_pct,
    round(avg(off_rating), 6) AS avg_off_rating, round(avg(def_rating), 6) AS avg_def_rating, round(avg(possessions), 6) AS avg_possessions
  FROM adv WHERE seconds > 0 GROUP BY 1, 2""")
def _(lg):
    return rounded(B.team_averages(lg.adv), *_AVG5)


@query("b6_total_points_created", "SELECT season, gamecode, player_id, points, pts_from_assists, total_pts_created FROM per_game")
def _(lg):
    return lg.per_game.select("season", "gamecode", "player_id", "points", "pts_from_assists", "total_pts_created")


_POSITIONS = """
  SELECT b.*, CASE WHEN r.ast_rank <= 2 AND n >= 3 THEN 'Guard' WHEN n >= 3 AND reb_rank = 1 THEN 'Center' ELSE 'Forward' END AS position
  FROM box b LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY season, gamecode, team_code ORDER BY ast_rank <= 2, total_rebounds / (assists + 1) DESC, player_id) AS reb_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY season, gamecode, team_code ORDER BY assists / (total_rebounds + 1) DESC, player_id) AS ast_rank,
            count(*) OVER (PARTITION BY season, gamecode, team_code) AS n FROM box WHERE seconds > 0)) r
  USING (season, gamecode, team_code, player_id)"""


@query("b8_position_classes", f"SELECT season, gamecode, team_code, player_id, position FROM ({_POSITIONS})")
def _(lg):
    return B.classify_positions(lg.box).select("season", "gamecode", "team_code", "player_id", "position")


def _share_sql(src: str) -> str:
    return f"""
  SELECT t.season, t.team_code, v.p AS position, coalesce(s.points, 0) AS points,
    CASE WHEN t.total > 0 THEN coalesce(s.points, 0) / t.total * 100 ELSE 0e0 END AS pct
  FROM (SELECT season, team_code, CAST(sum(points) AS BIGINT) AS total FROM box GROUP BY 1, 2) t
  CROSS JOIN (VALUES ('Guard'), ('Forward'), ('Center')) v(p)
  LEFT JOIN (SELECT season, team_code, position, CAST(sum(points) AS BIGINT) AS points FROM ({src}) GROUP BY 1, 2, 3) s
    ON s.season = t.season AND s.team_code = t.team_code AND s.position = v.p"""


@query("b9_positional_scoring", _share_sql("SELECT b.season, b.team_code, points, coalesce(position_group, 'Forward') AS position FROM box b LEFT JOIN player_dim d USING (player_id)"))
def _(lg):
    return B.positional_scoring(lg.box, lg.players)


@query("b9_positional_scoring_inferred", _share_sql(_POSITIONS))
def _(lg):
    return B.positional_scoring(lg.box)


_LEAD = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for c, n in B.LEADER_SUMS.items())
_LEADERS = f"""
  SELECT season, player_id AS player_code, player_name AS player_name_raw, a.team_code, t.team_name, {display('player_name')} AS player_name,
    count(DISTINCT gamecode) AS games, sum(seconds) / 60e0 AS minutes, {_LEAD},
    {ratio0('sum(fgm2)', 'sum(fga2)')} * 100 AS fg2_pct, {ratio0('sum(fgm3)', 'sum(fga3)')} * 100 AS fg3_pct, {ratio0('sum(ftm)', 'sum(fta)')} * 100 AS ft_pct
  FROM adv a LEFT JOIN teams t ON a.team_code = t.team_code WHERE seconds > 0 GROUP BY 1, 2, 3, 4, 5"""
_PG = ["minutes", *B.LEADER_SUMS.values()]


@query("b10_league_leaders", _LEADERS)
def _(lg):
    return B.league_leaders(lg.adv, lg.teams)


@query("b10_league_leaders_per_game", f"SELECT season, player_code, player_name_raw, team_code, team_name, player_name, games, {', '.join(f'{c} / games AS {c}' for c in _PG)}, fg2_pct, fg3_pct, ft_pct FROM ({_LEADERS})")
def _(lg):
    return B.league_leaders(lg.adv, lg.teams, per_game=True)


_SUMMARY = ["avg_ts_pct", "avg_off_rating", "avg_def_rating", "avg_true_usg_pct", "avg_net_rating"]


@query("b11_game_summary", """
  SELECT season, gamecode, count(*) AS players, round(avg(ts_pct), 6) AS avg_ts_pct, round(avg(off_rating), 6) AS avg_off_rating, round(avg(def_rating), 6) AS avg_def_rating,
    round(avg(true_usg_pct), 6) AS avg_true_usg_pct, round(avg(off_rating - def_rating), 6) AS avg_net_rating FROM adv WHERE seconds > 0 GROUP BY 1, 2""")
def _(lg):
    return rounded(B.game_summary(lg.adv), *_SUMMARY)


def _norm(c: str) -> str:
    n = f"({c} - min({c}) OVER w) / (CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1e0 ELSE max({c}) OVER w - min({c}) OVER w END)"
    return f"{'1 - ' if c == 'def_rating' else ''}{n} AS {c}_norm"


@query("b12_player_comparison", f"""
  SELECT season, gamecode, player_id, player_name, team_code, {', '.join(_norm(c) for c in B.COMPARED)}
  FROM adv WHERE seconds > 0 WINDOW w AS (PARTITION BY season, gamecode)""")
def _(lg):
    return B.player_comparison(lg.adv)


# -- filters ------------------------------------------------------------------
@query("f3_player_stat_search", f"SELECT season, gamecode, player_id, player_name, team_code, {STATS} FROM adv WHERE player_name ILIKE '%del%'")
def _(lg):
    return FL.search_player_stats(lg.adv, player_name="del").select("season", "gamecode", "player_id", "player_name", "team_code", *C.COUNT_STATS)


@query("f4_leader_qualifiers", f"""
  SELECT season, player_code, team_code, games, fga2 >= 40 AS q_fg2, fga3 >= 30 AS q_fg3, fta >= 30 AS q_ft FROM ({_LEADERS}) WHERE games >= 10""")
def _(lg):
    return FL.qualified_leaders(B.league_leaders(lg.adv, lg.teams)).select("season", "player_code", "team_code", "games", "q_fg2", "q_fg3", "q_ft")


# -- ranking ------------------------------------------------------------------
_Q = f"SELECT *, fga2 >= 40 AS q_fg2, fga3 >= 3 AS q_fg3, fta >= 3 AS q_ft FROM ({_LEADERS}) WHERE games >= 5"
_BOARDS = " UNION ALL ".join(
    f"SELECT season, player_code, player_name, team_code, '{b}' AS board, CAST({b} AS DOUBLE) AS value FROM qual" + (f" WHERE {q}" if q else "")
    for b, q in O.BOARDS.items()
)


@query("o1_leaderboards", f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, board ORDER BY value DESC, player_code, team_code) AS rank
    FROM (WITH qual AS ({_Q.replace('fga2 >= 40', 'fga2 >= 5')}) {_BOARDS})) WHERE rank <= 10""")
def _(lg):
    leaders = B.league_leaders(lg.adv, lg.teams)
    return O.leaderboards(FL.qualified_leaders(leaders, min_games=5, min_fga2=5, min_fga3=3, min_fta=3))


@query("o6_concat_frames", "SELECT season, gamecode, home_code, away_code, home_logo FROM (SELECT season, gamecode, home_code, away_code, NULL AS home_logo FROM schedule UNION ALL SELECT season, gamecode, home_code, away_code, home_logo FROM extra)")
def _(lg):
    return O.concat_frames(lg.schedule, lg.extra).select("season", "gamecode", "home_code", "away_code", "home_logo")


@query("o7_last_five_games", """
  SELECT * FROM (SELECT season, player_id, gamecode, points, row_number() OVER (PARTITION BY season, player_id ORDER BY gamecode DESC) AS games_ago
    FROM adv WHERE seconds > 0) WHERE games_ago <= 5""")
def _(lg):
    return O.last_games(lg.adv).select("season", "player_id", "gamecode", "points", "games_ago")


# -- player form --------------------------------------------------------------
_FORM = """
  SELECT *, rolling_avg > season_avg * 1.1e0 AS is_hot FROM (
    SELECT season, team_code, player_id, player_name, gamecode, CAST(total_pts_created AS DOUBLE) AS value,
      row_number() OVER o AS game_num, avg(total_pts_created) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_avg,
      avg(total_pts_created) OVER k AS season_avg, count(*) OVER k AS games
    FROM per_game WHERE seconds > 0 WINDOW k AS (PARTITION BY season, team_code, player_id), o AS (k ORDER BY gamecode)) WHERE games >= 2"""


@query("w3_player_form", _FORM)
def _(lg):
    return W.player_form(lg.per_game)


@query("w3_form_summary", f"""
  SELECT season, team_code, player_id, max(season_avg) AS season_avg, max(value) AS best, max_by(rolling_avg, game_num) AS last_avg, count(*) AS games,
    CASE WHEN max(season_avg) <> 0 THEN (max_by(rolling_avg, game_num) - max(season_avg)) / max(season_avg) * 100 ELSE 0e0 END AS trend_pct
  FROM ({_FORM}) GROUP BY 1, 2, 3""")
def _(lg):
    return W.form_summary(W.player_form(lg.per_game))


@query("w4_hot_streaks", f"""
  SELECT season, team_code, player_id, min(game_num) AS start_game, max(game_num) AS end_game
  FROM (SELECT *, game_num - row_number() OVER (PARTITION BY season, team_code, player_id ORDER BY game_num) AS island FROM ({_FORM}) WHERE is_hot)
  GROUP BY season, team_code, player_id, island""")
def _(lg):
    return W.hot_streaks(W.player_form(lg.per_game))


# -- quality ------------------------------------------------------------------
@query("q1_orphan_games", """
  SELECT t AS table_name, count(*) FILTER (known IS NULL) AS orphans FROM (
    SELECT DISTINCT 'boxscores' AS t, season, gamecode FROM box UNION SELECT 'play_by_play', season, gamecode FROM pbp
    UNION SELECT 'shots', season, gamecode FROM shots UNION SELECT 'player_advanced_stats', season, gamecode FROM adv
    UNION SELECT 'extra_rounds', season, gamecode FROM extra)
  LEFT JOIN (SELECT season, gamecode, TRUE AS known FROM games) USING (season, gamecode) GROUP BY 1""")
def _(lg):
    return Q.orphan_games({"boxscores": lg.box, "play_by_play": lg.pbp, "shots": lg.shots, "player_advanced_stats": lg.adv, "extra_rounds": lg.extra}, lg.games)


_SRC = {"games": "games", "boxscores": "box", "play_by_play": "pbp", "shots": "shots"}


@query("q2_null_identifiers", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows FROM {_SRC[t]}"
    for t, cs in Q.REQUIRED_IDS.items() for c in cs))
def _(lg):
    return Q.null_identifiers({"games": lg.games, "boxscores": lg.box, "play_by_play": lg.pbp, "shots": lg.shots})


@query("q3_boxscore_violations", """
  SELECT season, gamecode, player_id AS subject, r AS rule FROM (SELECT *, unnest([
      CASE WHEN fgm2 > fga2 THEN 'fgm2>fga2' END, CASE WHEN fgm3 > fga3 THEN 'fgm3>fga3' END, CASE WHEN ftm > fta THEN 'ftm>fta' END,
      CASE WHEN total_rebounds <> off_rebounds + def_rebounds THEN 'rebounds' END,
      CASE WHEN points <> fgm2 * 2 + fgm3 * 3 + ftm THEN 'points' END, CASE WHEN points < 0 THEN 'negative points' END,
      CASE WHEN minutes_str NOT LIKE '%:%' AND minutes_str <> 'DNP' THEN 'minutes' END]) AS r FROM box) WHERE r IS NOT NULL
  UNION ALL SELECT season, gamecode, team_code, 'five starters' FROM box GROUP BY 1, 2, 3 HAVING count(*) FILTER (is_starter = 1) <> 5
  UNION ALL SELECT season, gamecode, 'game', 'two teams' FROM box GROUP BY 1, 2 HAVING count(DISTINCT team_code) <> 2""")
def _(lg):
    return Q.boxscore_violations(lg.box)


@query("q4_play_by_play_violations", """
  SELECT season, gamecode, r AS rule FROM (SELECT season, gamecode, unnest([
      CASE WHEN max(period) < 4 THEN 'four periods' END,
      CASE WHEN count(*) FILTER (markertime <> '' AND markertime LIKE '%:%') <= 0.9e0 * count(*) FILTER (markertime <> '') THEN 'clock format' END,
      CASE WHEN count(*) <> count(DISTINCT true_numberofplay) THEN 'play order' END,
      CASE WHEN abs(count(*) FILTER (playtype = 'IN') - count(*) FILTER (playtype = 'OUT')) > 2 THEN 'substitutions' END]) AS r
    FROM pbp GROUP BY 1, 2) WHERE r IS NOT NULL""")
def _(lg):
    return Q.play_by_play_violations(lg.pbp)


@query("q5_shot_violations", """
  SELECT season, gamecode, num_anot, r AS rule FROM (SELECT *, unnest([
      CASE WHEN coord_x NOT BETWEEN -1000 AND 1000 THEN 'x range' END, CASE WHEN coord_y NOT BETWEEN -200 AND 1600 THEN 'y range' END,
      CASE WHEN points NOT IN (0, 1, 2, 3) THEN 'points' END,
      CASE WHEN coord_x IS NULL AND id_action NOT IN ('FTM', 'FTA') THEN 'no coordinates' END]) AS r FROM shots) WHERE r IS NOT NULL""")
def _(lg):
    return Q.shot_violations(lg.shots)


# -- the same rules over feeds with faults in them; the statements are the ledger of what was put in ----------
_VICTIMS = "is_home = 1 AND is_starter = 1"


def _damaged(df, where: str, every: int, faults: dict[int, dict[str, str]]):
    """``df`` with columns replaced in the rows of ``where``, by the remainder of the game's number."""
    new = {}
    for k, columns in faults.items():
        for c, value in columns.items():
            new[c] = F.when(F.expr(f"({where}) AND gamecode % {every} = {k}"), F.expr(value)).otherwise(new.get(c, F.col(c)))
    return df.withColumns({c: v.cast(df.schema[c].dataType) for c, v in new.items()})


@query("q3_seeded_boxscore_faults", f"""
  SELECT season, gamecode, player_id AS subject, rule FROM box JOIN (VALUES (0, 'fgm2>fga2'), (1, 'fgm3>fga3'), (2, 'ftm>fta'), (3, 'rebounds'), (4, 'points'), (5, 'points'), (5, 'negative points'),
    (6, 'minutes'), (7, 'home flag')) AS x(k, rule) ON gamecode % 11 = k WHERE {_VICTIMS}
  UNION ALL SELECT DISTINCT season, gamecode, team_code, 'five starters' FROM box WHERE is_home = 1 AND gamecode % 11 IN (8, 9)
  UNION ALL SELECT DISTINCT season, gamecode, 'game', 'two teams' FROM box WHERE gamecode % 11 = 9""")
def _(lg):
    return Q.boxscore_violations(_damaged(lg.box, _VICTIMS, 11, {
        0: {"fga2": "fgm2 - 1"}, 1: {"fga3": "fgm3 - 1"}, 2: {"fta": "ftm - 1"}, 3: {"total_rebounds": "total_rebounds + 1"}, 4: {"points": "points + 1"}, 5: {"points": "-1"},
        6: {"minutes_str": "'?'"}, 7: {"is_home": "2"}, 8: {"is_starter": "0"}, 9: {"team_code": "'???'"},
    }))


@query("q4_seeded_play_faults", """
  SELECT DISTINCT season, gamecode, rule FROM pbp JOIN (VALUES (0, 'four periods'), (1, 'known plays'), (2, 'clock format'), (3, 'play order'), (4, 'substitutions')) AS x(k, rule) ON gamecode % 7 = k""")
def _(lg):
    df = _damaged(lg.pbp, "true_numberofplay = 50", 7, {1: {"playtype": "'??'"}, 3: {"true_numberofplay": "51"}})
    df = _damaged(df, "true", 7, {0: {"period": "least(period, 3)"}, 2: {"markertime": "replace(markertime, ':', '.')"}, 4: {"playtype": "CASE WHEN playtype = 'IN' THEN 'OUT' ELSE playtype END"}})
    return Q.play_by_play_violations(df)


@query("q5_seeded_shot_faults", """
  SELECT season, gamecode, num_anot, 'x range' AS rule FROM shots WHERE gamecode % 6 = 0 AND coord_x IS NOT NULL
  UNION ALL SELECT season, gamecode, num_anot, 'y range' FROM shots WHERE gamecode % 6 = 1 AND coord_y IS NOT NULL
  UNION ALL SELECT season, gamecode, num_anot, 'points' FROM shots WHERE gamecode % 6 = 2
  UNION ALL SELECT season, gamecode, num_anot, 'action' FROM shots WHERE gamecode % 6 = 3
  UNION ALL SELECT season, gamecode, num_anot, 'no coordinates' FROM shots WHERE coord_x IS NULL AND id_action NOT IN ('FTM', 'FTA') AND gamecode % 6 <> 3""")
def _(lg):
    return Q.shot_violations(_damaged(lg.shots, "true", 6, {
        0: {"coord_x": "coord_x + 5000"}, 1: {"coord_y": "coord_y - 5000"}, 2: {"points": "7"}, 3: {"id_action": "'??'"}}))


@query("s24_field_profile", """
  SELECT 'season' AS column_name, 'int' AS dtype, count(*) AS rows, count(*) - count(season) AS null_rows, min(CAST(season AS VARCHAR)) AS sample FROM shots UNION ALL
  SELECT 'id_player', 'string', count(*), count(*) - count(id_player), min(id_player) FROM shots UNION ALL
  SELECT 'id_action', 'string', count(*), count(*) - count(id_action), min(id_action) FROM shots UNION ALL
  SELECT 'zone', 'string', count(*), count(*) - count(zone), min(zone) FROM shots UNION ALL
  SELECT 'points', 'int', count(*), count(*) - count(points), min(CAST(points AS VARCHAR)) FROM shots""")
def _(lg):
    return Q.field_profile(lg.shots.select("season", "id_player", "id_action", "zone", "points"))
