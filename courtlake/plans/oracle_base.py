"""Shared relations of the DuckDB statements: the same feeds and league tables, written for another engine.

``compose`` prefixes a statement with the relations it mentions.
"""

from __future__ import annotations

import re

from courtlake import config as C
from courtlake.sources.adapter import CLUBS, COUNTRIES, DAY_OFFSET, GIVEN, OFFICIAL_STEPS, PLAY_FIELDS, REFEREES, SURNAMES

AS_OF = "DATE '2024-10-09'"
FUTURE_AS_OF = "DATE '2150-01-01'"


def _pick(text: str, idx: str) -> str:
    return "split_part('" + text.replace("'", "''") + f"', ',', CAST({idx} + 1 AS INT))"


def _code(idx: str) -> str:
    raw = _pick(CLUBS, idx)
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TEAM_ALIASES.items())
    return f"(CASE {raw} {whens} ELSE {raw} END)"


def _moved(club: str, slot: str) -> str:
    return f"({club} + CASE WHEN {slot} = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18"


def _pid(club: str, slot: str) -> str:
    return f"('P' || lpad(CAST({_moved(club, slot)} AS VARCHAR), 2, '0') || lpad(CAST({slot} AS VARCHAR), 2, '0'))"


def _name(club: str, slot: str) -> str:
    return f"({_pick(SURNAMES, slot)} || ', ' || {_pick(GIVEN, f'({_moved(club, slot)}) % 9')})"


def title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), lambda t: upper(t[1]) || t[2:]), '')"


def display(c: str) -> str:
    return f"(trim({title(f'split_part({c}, chr(44), 1)')}) || ' ' || upper(substr(trim(split_part({c}, ',', 2)), 1, 1)) || '.')"


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


def ratio0(n: str, d: str) -> str:
    return f"coalesce({ratio(n, d)}, 0e0)"


PTS = "(CASE playtype WHEN '2FGM' THEN 2 WHEN '3FGM' THEN 3 WHEN 'FTM' THEN 1 ELSE 0 END)"
POSS = "(playtype IN ('2FGM','2FGA','3FGM','3FGA','TO','D'))"
MONTH = "(CASE month(game_day) WHEN 10 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 7 WHEN 5 THEN 8 END)"
_MMSS = "lpad(CAST(sec // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0')"
_LIVE = "g % 25 = 24"
_BOXC = {
    "fgm2": "'2FGM'", "fga2": "'2FGM','2FGA'", "fgm3": "'3FGM'", "fga3": "'3FGM','3FGA'", "ftm": "'FTM'", "fta": "'FTM','FTA'",
    "off_rebounds": "'O'", "def_rebounds": "'D'", "total_rebounds": "'O','D'", "assists": "'AS'", "steals": "'ST'", "turnovers": "'TO'",
    "blocks_favour": "'FV'", "blocks_against": "'AG'", "fouls_committed": "'CM','CMU','OF'", "fouls_received": "'RV'",
}
STATS = ", ".join(C.COUNT_STATS)

CTES: dict[str, str] = {}

CTES["ev"] = "SELECT " + PLAY_FIELDS.replace("{div}", "//").replace("{k}", "CAST(json_extract_string(props, '$.k') AS INT)") + " FROM events"
CTES["pbp"] = f"""
  SELECT 2024 + sn AS season, gi + 1 AS gamecode, g, p, side, pt AS playtype, r0, hi, ai,
    CASE WHEN pt IN ('BP','EP','TOUT') THEN NULL ELSE {_pid('club', 'slot')} END AS player_id,
    CASE WHEN pt IN ('BP','EP','TOUT') THEN NULL ELSE {_name('club', 'slot')} END AS player,
    CASE WHEN pt IN ('BP','EP') THEN NULL ELSE {_code('club')} END AS codeteam,
    {_code('hi')} AS home_team, {_code('ai')} AS away_team,
    period, CASE WHEN pt = 'TOUT' THEN '' ELSE {_MMSS} END AS markertime,
    CASE WHEN pt = 'TOUT' THEN 0 ELSE sec END AS clock_secs, p + 1 AS numberofplay, p + 1 AS true_numberofplay,
    CASE WHEN pts > 0 THEN CAST(sum(CASE WHEN side = 0 THEN pts ELSE 0 END) OVER o AS BIGINT) END AS points_a,
    CASE WHEN pts > 0 THEN CAST(sum(CASE WHEN side = 1 THEN pts ELSE 0 END) OVER o AS BIGINT) END AS points_b,
    CASE WHEN pts > 0 AND g % 3 = 0 THEN 'Score (' || CAST(sum(CASE WHEN side = 0 THEN pts ELSE 0 END) OVER o AS BIGINT) || '-'
      || CAST(sum(CASE WHEN side = 1 THEN pts ELSE 0 END) OVER o AS BIGINT) || ')' END AS comment
  FROM ev WINDOW o AS (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["gamerows"] = """
  SELECT g, sn, gi, r0, pair, hi, ai, CAST(sum(CASE WHEN side = 0 THEN pts ELSE 0 END) AS BIGINT) AS home_pts,
    CAST(sum(CASE WHEN side = 1 THEN pts ELSE 0 END) AS BIGINT) AS away_pts
  FROM ev GROUP BY ALL"""
CTES["box"] = f"""
  SELECT 2024 + sn AS season, gi + 1 AS gamecode, {_pid('club', 'slot')} AS player_id, {_name('club', 'slot')} AS player_name,
    {_code('club')} AS team_code, 1 - side AS is_home, CASE WHEN slot < 5 THEN 1 ELSE 0 END AS is_starter,
    CASE WHEN slot < 10 THEN 1 ELSE 0 END AS is_playing, CAST(slot + 4 AS VARCHAR) AS dorsal,
    CASE WHEN slot < 10 THEN lpad(CAST(secs // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') ELSE 'DNP' END AS minutes_str,
    CASE WHEN slot < 10 THEN secs ELSE 0 END AS seconds, CASE WHEN slot < 10 THEN secs ELSE 0 END / 60e0 AS minutes,
    coalesce(points, 0) AS points, {', '.join(f'coalesce(c.{c}, 0) AS {c}' for c in _BOXC)}, (g * 7 + slot * 3) % 41 - 20 AS plus_minus,
    coalesce(points, 0) + coalesce(total_rebounds, 0) + coalesce(assists, 0) - coalesce(turnovers, 0) AS valuation
  FROM (SELECT *, CASE WHEN side = 0 THEN hi ELSE ai END AS club, 300 + (slot * 419 + g * 37) % 1500 AS secs
        FROM (SELECT DISTINCT g, sn, gi, r0, hi, ai FROM ev), range(2) a(side), range(12) b(slot)) r
  LEFT JOIN (SELECT g, side, slot, CAST(sum(pts) AS BIGINT) AS points,
               {', '.join(f'count(*) FILTER (pt IN ({v})) AS {c}' for c, v in _BOXC.items())}
             FROM ev GROUP BY g, side, slot) c USING (g, side, slot)"""
CTES["shots"] = f"""
  SELECT 2024 + sn AS season, gi + 1 AS gamecode, p + 1 AS num_anot, {_code('club')} AS team, {_pid('club', 'slot')} AS id_player,
    {_name('club', 'slot')} AS player, pt AS id_action, CASE WHEN pts > 0 THEN 'Made ' ELSE 'Missed ' END || substr(pt, 1, 1) AS action,
    pts AS points, CASE WHEN fg AND k % 17 <> 1 THEN CAST((u * 37 + k * 11 + p * 5) % 1401 - 700 AS DOUBLE) END AS coord_x,
    CASE WHEN fg AND k % 17 <> 1 THEN CAST((u * 13 + k * 29) % 1000 - 50 AS DOUBLE) END AS coord_y,
    CASE WHEN fg THEN substr('ABCDEFGHIJ', k % 10 + 1, 1) END AS zone, k % 2 AS fastbreak, u % 2 AS second_chance,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS pts_off_turnover, (period - 1) * 10 + (600 - sec) // 60 + 1 AS minute,
    {_MMSS} AS console, sa AS points_a, sb AS points_b,
    CASE WHEN pt LIKE '3FG%' THEN 3 ELSE 2 END AS shot_value, CASE WHEN pts > 0 THEN 1 ELSE 0 END AS made
  FROM (SELECT *, pt NOT IN ('FTM','FTA') AS fg, CAST(sum(CASE WHEN side = 0 THEN pts ELSE 0 END) OVER o AS BIGINT) AS sa,
          CAST(sum(CASE WHEN side = 1 THEN pts ELSE 0 END) OVER o AS BIGINT) AS sb
        FROM ev WINDOW o AS (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE pt IN ('2FGM','2FGA','3FGM','3FGA','FTM','FTA')"""
CTES["schedule"] = f"""
  SELECT 2024 + sn AS season, r0 + 1 AS round, 'RS' AS round_name, gi + 1 AS gamecode, NOT ({_LIVE}) AS played,
    {_code('hi')} AS home_code, 'Club ' || {_pick(CLUBS, 'hi')} AS home_name, CASE WHEN NOT ({_LIVE}) THEN home_pts END AS home_score,
    {_code('ai')} AS away_code, 'Club ' || {_pick(CLUBS, 'ai')} AS away_name, CASE WHEN NOT ({_LIVE}) THEN away_pts END AS away_score,
    CASE WHEN g % 11 = 5 THEN strftime(day, '%Y-%m-%d') WHEN g % 13 = 6 THEN strftime(day, '%B %-d, %Y') ELSE strftime(day, '%b %d, %Y') END AS date,
    day AS game_day, g
  FROM (SELECT *, CAST(make_date(2024 + sn % 100, 10, 1) + CAST({DAY_OFFSET} AS INT) AS DATE) AS day FROM gamerows)"""
CTES["metadata"] = f"""
  SELECT 2024 + sn AS season, gi + 1 AS gamecode, r0 + 1 AS round, 'Arena ' || {_pick(CLUBS, 'hi')} AS stadium, {_code('hi')} AS home_team,
    {_code('ai')} AS away_team, home_pts AS home_score, away_pts AS away_score, 'Coach ' || {_pick(CLUBS, 'hi')} AS home_coach,
    'Coach ' || {_pick(CLUBS, 'ai')} AS away_coach, {_pick(REFEREES, f'((g + {OFFICIAL_STEPS[0]}) % 7)')} AS referee1,
    {_pick(REFEREES, f'((g + {OFFICIAL_STEPS[1]}) % 7)')} AS referee2,
    CASE WHEN g % 6 = 1 THEN NULL ELSE {_pick(REFEREES, f'((g + {OFFICIAL_STEPS[2]}) % 7)')} END AS referee3
  FROM gamerows"""
CTES["extra"] = f"""
  SELECT 2024 + sn AS season, r0 + 18 + pair // 2 * 6 AS round, 'RS' AS round_name, gi + 1001 AS gamecode, pair < 3 AS played,
    {_code('ai')} AS home_code, 'Club ' || {_pick(CLUBS, 'ai')} AS home_name, CASE WHEN pair < 3 THEN away_pts END AS home_score,
    {_code('hi')} AS away_code, 'Club ' || {_pick(CLUBS, 'hi')} AS away_name, CASE WHEN pair < 3 THEN home_pts END AS away_score,
    'crest/' || {_pick(CLUBS, 'ai')} AS home_logo, 'crest/' || {_pick(CLUBS, 'hi')} AS away_logo,
    strftime(CAST(DATE '2200-01-01' + CAST({DAY_OFFSET} AS INT) AS DATE), '%b %d, %Y') AS date,
    CAST(DATE '2200-01-01' + CAST({DAY_OFFSET} AS INT) AS DATE) AS game_day
  FROM gamerows WHERE NOT (pair = 8 AND r0 % 2 = 0)"""
CTES["logos"] = f"""
  SELECT {_code('t')} AS team_code, max('crest/' || {_pick(CLUBS, 't')}) AS logo_url
  FROM (SELECT hi AS t FROM gamerows UNION ALL SELECT ai FROM gamerows) GROUP BY 1"""
CTES["games"] = """
  SELECT s.season, s.gamecode, home_code AS home_team, away_code AS away_team, s.home_score, s.away_score, date AS game_date, game_day,
    s.round, played, referee1, referee2, referee3 FROM schedule s LEFT JOIN metadata m USING (season, gamecode)"""
CTES["fixtures"] = """
  SELECT season, gamecode, home_code AS home_team, away_code AS away_team, home_score, away_score, date AS game_date, game_day, round, played FROM schedule
  UNION ALL SELECT season, gamecode, home_code, away_code, NULL, NULL, date, game_day, round, FALSE FROM extra"""
CTES["teams"] = """
  SELECT team_code, max(team_name) AS team_name, max(logo_url) AS logo_url
  FROM (SELECT home_code AS team_code, home_name AS team_name FROM schedule UNION ALL SELECT away_code, away_name FROM schedule)
  LEFT JOIN logos USING (team_code) GROUP BY 1"""
_N = "(t * 12 + slot)"
CTES["players"] = f"""
  SELECT 'P' || lpad(CAST(t AS VARCHAR), 2, '0') || lpad(CAST(slot AS VARCHAR), 2, '0') AS player_id,
    {_pick(SURNAMES, 'slot')} || ', ' || {_pick(GIVEN, 't % 9')} AS player_name, {_code('t')} AS team_code, CAST(slot + 4 AS VARCHAR) AS dorsal,
    CASE WHEN slot = 11 THEN NULL ELSE 178 + ({_N} * 37) % 45 END AS height,
    CASE WHEN {_N} % 23 = 5 THEN NULL ELSE CAST(DATE '1986-01-01' + CAST(({_N} * 149) % 7000 AS INT) AS DATE) END AS birthdate,
    CASE slot % 3 WHEN 0 THEN CASE WHEN {_N} % 2 = 0 THEN 'guard' ELSE 'G' END
      WHEN 1 THEN CASE WHEN t % 4 = 0 THEN 'forward-center' ELSE 'Forward' END ELSE 'Center' END AS position,
    {_pick(COUNTRIES, f'{_N} % 9')} AS country
  FROM (SELECT DISTINCT (club + CASE WHEN slot = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18 AS t, slot
        FROM (SELECT hi AS club, r0 FROM gamerows UNION SELECT ai, r0 FROM gamerows), range(12) b(slot))"""
CTES["player_dim"] = f"""
  SELECT player_id, player_name, team_code, height, birthdate, country, {display('player_name')} AS display_name,
    datesub('year', birthdate, {AS_OF}) AS age,
    CASE WHEN datesub('year', birthdate, {AS_OF}) < 25 THEN 'Under 25' WHEN datesub('year', birthdate, {AS_OF}) <= 30 THEN '25-30'
         WHEN datesub('year', birthdate, {AS_OF}) > 30 THEN '31+ (Veterans)' END AS age_bracket,
    CASE position WHEN 'guard' THEN 'Guard' WHEN 'G' THEN 'Guard' WHEN 'Center' THEN 'Center' ELSE 'Forward' END AS position_group, position
  FROM players"""
CTES["archetypes"] = """
  SELECT *, CASE WHEN position_group = 'Guard' AND height > 195 THEN 'Tall Playmaker' WHEN position_group = 'Guard' AND height <= 195 THEN 'Standard Guard'
    WHEN position_group = 'Center' AND height > 200 THEN 'Stretch Big' WHEN position_group = 'Center' AND height <= 200 THEN 'Undersized Big'
    WHEN position_group = 'Forward' AND height > 205 THEN 'Tall Forward' WHEN position_group = 'Forward' AND height <= 205 THEN 'Standard Forward' END AS archetype
  FROM player_dim"""

# -- box score ----------------------------------------------------------------
CTES["team_poss"] = """
  SELECT *, (team_fga * 100 + team_fta * 44 - team_orb * 100 + team_tov * 100) / 100e0 AS team_poss, team_seconds / 60e0 AS team_minutes
  FROM (SELECT season, gamecode, team_code, CAST(sum(fga2 + fga3) AS BIGINT) AS team_fga, CAST(sum(fta) AS BIGINT) AS team_fta,
    CAST(sum(off_rebounds) AS BIGINT) AS team_orb, CAST(sum(turnovers) AS BIGINT) AS team_tov, CAST(sum(points) AS BIGINT) AS team_points,
    CAST(sum(seconds) AS BIGINT) AS team_seconds, CAST(sum(assists) AS BIGINT) AS team_assists,
    CAST(sum(fouls_received) AS BIGINT) AS team_fouls_received FROM box GROUP BY 1, 2, 3)"""
CTES["team_drtg"] = """
  SELECT t.*, o.team_points AS opp_points, CASE WHEN t.team_poss > 0 THEN o.team_points / t.team_poss * 100 END AS def_rating
  FROM team_poss t LEFT JOIN team_poss o ON t.season = o.season AND t.gamecode = o.gamecode AND t.team_code <> o.team_code"""
CTES["adv"] = f"""
  SELECT *, {ratio('points * 50', '(fga2 + fga3) * 100 + fta * 44')} AS ts_pct,
    CASE WHEN possessions > 0 THEN points / possessions * 100 END AS off_rating,
    CASE WHEN possessions > 0 THEN ((fga2 + fga3) * 100 + fta * 44 + (turnovers + assists) * 100 + fouls_received * 100) / 100e0 / possessions END AS true_usg_pct,
    CASE WHEN possessions > 0 THEN (steals + blocks_favour + def_rebounds) / possessions END AS stop_rate
  FROM (SELECT b.season, b.gamecode, player_id, player_name, b.team_code, is_home, seconds, minutes, {STATS},
          team_poss * (CASE WHEN team_seconds > 0 THEN CAST(seconds AS DOUBLE) / team_seconds ELSE 0e0 END) AS possessions, def_rating
        FROM box b JOIN team_drtg t ON b.season = t.season AND b.gamecode = t.gamecode AND b.team_code = t.team_code)"""
CTES["team_games"] = """
  SELECT season, gamecode, round, game_day, played, home_team AS team_code, away_team AS opponent, TRUE AS is_home, home_score AS pts_for, away_score AS pts_against FROM games
  UNION ALL SELECT season, gamecode, round, game_day, played, away_team, home_team, FALSE, away_score, home_score FROM games"""
CTES["eff"] = """
  SELECT p.season, p.team_code, t.team_name, t.logo_url, g.games, p.possessions, p.possessions / g.games AS pace, g.pf / p.possessions * 100 AS ortg,
    g.pa / p.possessions * 100 AS drtg, g.pf / p.possessions * 100 - g.pa / p.possessions * 100 AS net_rtg
  FROM (SELECT season, team_code, sum(possessions) AS possessions FROM adv GROUP BY 1, 2) p JOIN teams t USING (team_code)
  JOIN (SELECT season, team_code, count(gamecode) AS games, CAST(sum(pts_for) AS BIGINT) AS pf, CAST(sum(pts_against) AS BIGINT) AS pa
        FROM team_games WHERE played GROUP BY 1, 2) g USING (season, team_code)"""

# -- lineups: closed form, independent of the substitution fold -----------------
def _slots(side: int) -> str:
    swaps = f"((((p + 1) // 10) + 1 - (g + {side}) % 2) // 2)"
    out = f"(p % 10 = 8 AND (p // 10 + g) % 2 = {side})"
    club = "hi" if side == 0 else "ai"
    pid = f"'P' || lpad(CAST(({club} + CASE WHEN (m + i) % 10 = 9 AND r0 >= 6 THEN 1 ELSE 0 END) % 18 AS VARCHAR), 2, '0') || lpad(CAST((m + i) % 10 AS VARCHAR), 2, '0')"
    first = f"CASE WHEN {out} THEN 1 ELSE 0 END"
    return pid.replace("(m + i)", f"({swaps} + i)"), first


_H, _HF = _slots(0)
_A, _AF = _slots(1)
CTES["lu"] = f"""
  SELECT *, list_sort(list_transform(range({_HF}, 5), lambda i: {_H})) AS home_lineup,
    list_sort(list_transform(range({_AF}, 5), lambda i: {_A})) AS away_lineup FROM pbp"""
CTES["sided"] = f"""
  SELECT season, gamecode, p, home_team AS team, away_team AS opponent, home_lineup AS lineup, 1 AS is_home,
    CASE WHEN codeteam = home_team THEN {PTS} ELSE 0 END AS pf, CASE WHEN codeteam = away_team THEN {PTS} ELSE 0 END AS pa,
    CASE WHEN codeteam = home_team AND {POSS} THEN 1 ELSE 0 END AS tp, CASE WHEN codeteam = away_team AND {POSS} THEN 1 ELSE 0 END AS op FROM lu
  UNION ALL
  SELECT season, gamecode, p, away_team, home_team, away_lineup, 0,
    CASE WHEN codeteam = away_team THEN {PTS} ELSE 0 END, CASE WHEN codeteam = home_team THEN {PTS} ELSE 0 END,
    CASE WHEN codeteam = away_team AND {POSS} THEN 1 ELSE 0 END, CASE WHEN codeteam = home_team AND {POSS} THEN 1 ELSE 0 END FROM lu"""
CTES["lineup_stats"] = """
  SELECT *, pts_for / poss * 100 AS ortg, pts_against / poss * 100 AS drtg, pts_for / poss * 100 - pts_against / poss * 100 AS net_rtg
  FROM (SELECT season, team, lineup, count(*) AS events, CAST(sum(pf) AS BIGINT) AS pts_for, CAST(sum(pa) AS BIGINT) AS pts_against,
          greatest((sum(tp) + sum(op)) / 2e0, 1e0) AS poss FROM sided WHERE len(lineup) = 5 GROUP BY 1, 2, 3)"""
_OO = ", ".join(
    f"{s}_{c}" for s in ("on", "off") for c in ("events", "pts_for", "pts_against", "poss")
)
CTES["onoff_raw"] = """
  SELECT a.season, a.gamecode, a.team, a.player_id, on_events, on_f, on_a, greatest(on_n / 2e0, 1e0) AS on_poss,
    all_events - on_events AS off_events, all_f - on_f AS off_f, all_a - on_a AS off_a, greatest((all_n - on_n) / 2e0, 1e0) AS off_poss
  FROM (SELECT season, gamecode, team, player_id, count(*) AS on_events, CAST(sum(pf) AS BIGINT) AS on_f, CAST(sum(pa) AS BIGINT) AS on_a, CAST(sum(tp + op) AS BIGINT) AS on_n
        FROM (SELECT *, unnest(lineup) AS player_id FROM sided) GROUP BY 1, 2, 3, 4) a
  JOIN (SELECT season, gamecode, team, count(*) AS all_events, CAST(sum(pf) AS BIGINT) AS all_f, CAST(sum(pa) AS BIGINT) AS all_a, CAST(sum(tp + op) AS BIGINT) AS all_n
        FROM sided GROUP BY 1, 2, 3) t USING (season, gamecode, team)"""


def _oo(poss_on: str, poss_off: str) -> str:
    r = []
    for s, p in (("on", poss_on), ("off", poss_off)):
        r += [f"{s}_f / {p} * 100 AS {s}_ortg", f"{s}_a / {p} * 100 AS {s}_drtg", f"{s}_f / {p} * 100 - {s}_a / {p} * 100 AS {s}_net_rtg"]
    r.append(f"(on_f / {poss_on} * 100 - on_a / {poss_on} * 100) - (off_f / {poss_off} * 100 - off_a / {poss_off} * 100) AS on_off_diff")
    return ", ".join(r)


CTES["box_names"] = f"SELECT season, gamecode, player_id, team_code, {display('min(player_name)')} AS player_name FROM box GROUP BY 1, 2, 3, 4"
CTES["onoff"] = f"""
  SELECT o.season, o.gamecode, o.team, o.player_id, n.player_name, on_events, on_f AS on_pts_for, on_a AS on_pts_against, on_poss,
    off_events, off_f AS off_pts_for, off_a AS off_pts_against, off_poss, {_oo('on_poss', 'off_poss')}
  FROM onoff_raw o LEFT JOIN box_names n ON o.season = n.season AND o.gamecode = n.gamecode AND o.player_id = n.player_id AND o.team = n.team_code"""
CTES["season_onoff"] = f"""
  SELECT season, player_id, team, player_name, games, on_events, on_f AS on_pts_for, on_a AS on_pts_against, on_poss,
    off_events, off_f AS off_pts_for, off_a AS off_pts_against, off_poss, {_oo('greatest(on_poss, 1e0)', 'greatest(off_poss, 1e0)')}
  FROM (SELECT season, player_id, team, max_by(player_name, gamecode) AS player_name, count(DISTINCT gamecode) AS games,
          CAST(sum(on_events) AS BIGINT) AS on_events, CAST(sum(on_pts_for) AS BIGINT) AS on_f, CAST(sum(on_pts_against) AS BIGINT) AS on_a, sum(on_poss) AS on_poss,
          CAST(sum(off_events) AS BIGINT) AS off_events, CAST(sum(off_pts_for) AS BIGINT) AS off_f, CAST(sum(off_pts_against) AS BIGINT) AS off_a, sum(off_poss) AS off_poss
        FROM onoff GROUP BY 1, 2, 3)"""

# -- clutch and assists ---------------------------------------------------------
CTES["filled"] = """
  SELECT *, coalesce(last_value(points_a IGNORE NULLS) OVER o, 0) AS score_a, coalesce(last_value(points_b IGNORE NULLS) OVER o, 0) AS score_b
  FROM pbp WINDOW o AS (PARTITION BY season, gamecode ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["clutch"] = "SELECT * FROM filled WHERE period >= 4 AND clock_secs <= 300 AND abs(score_a - score_b) <= 5"
CTES["prior"] = """
  SELECT *, last_value(CASE WHEN playtype <> 'AS' THEN p END IGNORE NULLS)
    OVER (PARTITION BY season, gamecode ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shot_p FROM pbp"""
CTES["pairs"] = """
  SELECT a.season, a.gamecode, a.true_numberofplay AS assist_play, a.player_id AS passer_id, a.player AS passer_name, s.player_id AS shooter_id,
    s.player AS shooter_name, a.codeteam AS team, CASE s.playtype WHEN '3FGM' THEN 3 ELSE 2 END AS shot_value, s.playtype AS play_type,
    s.period, s.clock_secs, s.numberofplay
  FROM prior a JOIN pbp s ON a.season = s.season AND a.gamecode = s.gamecode AND a.shot_p = s.p
  WHERE a.playtype = 'AS' AND s.playtype IN ('2FGM','3FGM') AND s.codeteam = a.codeteam"""
CTES["asked"] = """
  SELECT *, (period - 1) * 10 + (10 - clock_secs / 60e0) AS minute,
    row_number() OVER (PARTITION BY season, gamecode, shooter_id, play_type ORDER BY assist_play) AS n FROM pairs"""
CTES["matched"] = """
  SELECT DISTINCT season, gamecode, shooter_id, play_type, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM asked
  UNION ALL
  SELECT m.season, m.gamecode, m.shooter_id, m.play_type, a.n, list_append(any_value(m.used), arg_min(s.num_anot, (abs(s.minute - a.minute), s.num_anot))),
    arg_min(s.num_anot, (abs(s.minute - a.minute), s.num_anot))
  FROM matched m JOIN asked a ON a.season = m.season AND a.gamecode = m.gamecode AND a.shooter_id = m.shooter_id AND a.play_type = m.play_type AND a.n = m.n + 1
  LEFT JOIN shots s ON s.season = a.season AND s.gamecode = a.gamecode AND s.id_player = a.shooter_id AND s.id_action = a.play_type
    AND s.points > 0 AND NOT list_contains(m.used, s.num_anot)
  GROUP BY m.season, m.gamecode, m.shooter_id, m.play_type, a.n"""
CTES["links"] = """
  SELECT a.*, s.coord_x, s.coord_y, s.zone, m.pick AS num_anot,
    CASE WHEN a.shot_value = 3 THEN CASE WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 680 THEN 0.37e0 ELSE 0.35e0 END
         ELSE CASE WHEN coord_x IS NULL OR coord_y IS NULL THEN 0.50e0
                   WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 150 THEN 0.65e0
                   WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 300 THEN 0.42e0 ELSE 0.38e0 END END * a.shot_value AS xp
  FROM asked a JOIN matched m ON a.season = m.season AND a.gamecode = m.gamecode AND a.shooter_id = m.shooter_id AND a.play_type = m.play_type AND a.n = m.n
  LEFT JOIN shots s ON s.season = a.season AND s.gamecode = a.gamecode AND s.num_anot = m.pick"""
CTES["per_game"] = """
  SELECT a.*, coalesce(c.pts_from_assists, 0) AS pts_from_assists, points + coalesce(c.pts_from_assists, 0) AS total_pts_created
  FROM adv a LEFT JOIN (SELECT season, gamecode, passer_id AS player_id, CAST(sum(shot_value) AS BIGINT) AS pts_from_assists FROM pairs GROUP BY 1, 2, 3) c
    USING (season, gamecode, player_id)"""

_RECURSIVE = {"matched"}


def _mentioned(sql: str) -> set[str]:
    return {n for n in CTES if re.search(rf"\b{n}\b", sql)}


def compose(sql: str) -> str:
    """The statement with every relation it mentions, directly or through another relation."""
    need, todo = set(), _mentioned(sql)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo |= _mentioned(CTES[name]) - need
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in need]
    if not parts:
        return sql
    return ("WITH RECURSIVE " if need & _RECURSIVE else "WITH ") + ",\n".join(parts) + "\n" + sql
