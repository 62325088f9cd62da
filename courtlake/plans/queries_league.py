"""Team, league, scouting and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlake.functions import exprs as X
from courtlake.operators import filters as FL, league as T, ranking as O, windows as W
from courtlake.plans.oracle_base import MONTH, display, ratio, ratio0
from courtlake.plans.registry import query, rounded
from courtlake.sources import adapter as A



def _as_of():
    return F.to_date(F.lit("2024-10-09"))


_WON = "pts_for > pts_against"

# -- season feeds: shared relations -------------------------------------------
_FEED = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in A._FEED_SUMS.items())
_OFF = f"SELECT season, team_code, count(DISTINCT gamecode) AS gp, {_FEED} FROM box GROUP BY 1, 2"
_OPP = f"""SELECT b.season, t.team_code, count(DISTINCT b.gamecode) AS gp, {_FEED} FROM box b
  JOIN (SELECT DISTINCT season, gamecode, team_code FROM box) t ON t.season = b.season AND t.gamecode = b.gamecode AND t.team_code <> b.team_code GROUP BY 1, 2"""
_FP = "((twoPointersAttempted + threePointersAttempted) * 100 + freeThrowsAttempted * 44 - offensiveRebounds * 100 + turnovers * 100) / 100e0"


@query("t1_efficiency_landscape", "SELECT season, team_code, team_name, logo_url, games, round(possessions, 6) AS possessions, round(pace, 6) AS pace, round(ortg, 6) AS ortg, round(drtg, 6) AS drtg, round(net_rtg, 6) AS net_rtg FROM eff")
def _(lg):
    return rounded(lg.efficiency, "possessions", "pace", "ortg", "drtg", "net_rtg")


_T2 = f"""
  SELECT o.season, o.team_code, 'Club ' || o.team_code AS team_name, o.pointsScored / o.po * 100 AS ortg, d.pointsScored / d.po * 100 AS drtg,
    o.pointsScored / o.po * 100 - d.pointsScored / d.po * 100 AS net_rtg, o.po / o.gp AS pace, o.po AS poss_off
  FROM (SELECT *, {_FP} AS po FROM ({_OFF})) o JOIN (SELECT *, {_FP} AS po FROM ({_OPP})) d USING (season, team_code)"""


@query("t2_feed_efficiency", _T2)
def _(lg):
    return T.feed_efficiency(A.team_feed(lg.box), A.team_feed(lg.box, opponents=True))


@query("t3_situational_scoring", """
  SELECT season, team_code, CAST(sum(fgm2 * 2) AS BIGINT) AS pts_from_2pt, CAST(sum(fgm3 * 3) AS BIGINT) AS pts_from_3pt, CAST(sum(ftm) AS BIGINT) AS pts_from_ft,
    CAST(sum(points) AS BIGINT) AS total_pts, sum(fgm2 * 2) / sum(points) * 100 AS pts_from_2pt_pct, sum(fgm3 * 3) / sum(points) * 100 AS pts_from_3pt_pct,
    sum(ftm) / sum(points) * 100 AS pts_from_ft_pct, count(DISTINCT gamecode) AS games, sum(steals) / count(DISTINCT gamecode) AS steals_pg,
    sum(turnovers) / count(DISTINCT gamecode) AS turnovers_pg, sum(off_rebounds) / count(DISTINCT gamecode) AS off_reb_pg, sum(assists) / count(DISTINCT gamecode) AS assists_pg
  FROM adv WHERE points > 0 GROUP BY 1, 2""")
def _(lg):
    return T.situational_scoring(lg.adv)


def _t10(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST((2000 * ({n}) + ({d})) // (2 * ({d})) AS BIGINT) END"


def _pct(n: str, d: str) -> str:
    t = _t10(n, d)
    return f"CAST((({t}) // 10) || '.' || (({t}) % 10) AS DOUBLE) / 100e0"


_FGA = "twoPointersAttempted + threePointersAttempted"


@query("t3_feed_situational_scoring", f"""
  SELECT season, team_code, 'Club ' || team_code AS team_name, {_pct('2 * twoPointersMade', 'pointsScored')} * 100 AS pts_from_2pt_pct,
    {_pct('3 * threePointersMade', 'pointsScored')} * 100 AS pts_from_3pt_pct, {_pct('freeThrowsMade', 'pointsScored')} * 100 AS pts_from_ft_pct,
    {_pct('2 * twoPointersMade + 3 * threePointersMade', f'2 * ({_FGA})')} * 100 AS efg_pct,
    {_pct('50 * pointsScored', f'100 * ({_FGA}) + 44 * freeThrowsAttempted')} * 100 AS ts_pct, pointsScored / gp AS points_per_game, steals / gp AS steals_pg,
    turnovers / gp AS turnovers_pg, offensiveRebounds / gp AS off_reb_pg, assists / gp AS assists_pg FROM ({_OFF})""")
def _(lg):
    return T.feed_situational_scoring(A.team_advanced_feed(lg.box), A.team_feed(lg.box))


_VEN = f"""SELECT season, team_code, count(*) FILTER (is_home) AS hg, count(*) FILTER (NOT is_home) AS ag, count(*) FILTER (is_home AND {_WON}) AS hw,
    count(*) FILTER (NOT is_home AND {_WON}) AS aw, CAST(sum(pts_for) FILTER (is_home) AS BIGINT) AS hf, CAST(sum(pts_against) FILTER (is_home) AS BIGINT) AS ha,
    CAST(sum(pts_for) FILTER (NOT is_home) AS BIGINT) AS af, CAST(sum(pts_against) FILTER (NOT is_home) AS BIGINT) AS aa FROM team_games WHERE played GROUP BY 1, 2"""
_SPLIT = ["home_ortg", "home_drtg", "home_net", "away_ortg", "away_drtg", "away_net", "home_adv_diff"]


@query("t4_home_away_splits", f"""
  SELECT season, team_code, hg AS home_games, hw / hg * 100 AS home_win_pct, round(hf / hp * 100, 6) AS home_ortg, round(ha / hp * 100, 6) AS home_drtg,
    round(hf / hp * 100 - ha / hp * 100, 6) AS home_net, ag AS away_games, aw / ag * 100 AS away_win_pct, round(af / ap * 100, 6) AS away_ortg,
    round(aa / ap * 100, 6) AS away_drtg, round(af / ap * 100 - aa / ap * 100, 6) AS away_net,
    round((hf / hp * 100 - ha / hp * 100) - (af / ap * 100 - aa / ap * 100), 6) AS home_adv_diff
  FROM ({_VEN}) JOIN (SELECT season, team_code, sum(possessions) FILTER (is_home = 1) AS hp, sum(possessions) FILTER (is_home = 0) AS ap FROM adv GROUP BY 1, 2)
    USING (season, team_code) WHERE hg > 0 AND ag > 0 AND hp IS NOT NULL AND ap IS NOT NULL""")
def _(lg):
    return rounded(T.home_away_splits(lg.adv, lg.games), *_SPLIT)


def _v(f: str, n: str) -> str:
    return f"{ratio0(f, f'pace * coalesce({n}, 0)')} * 100"


@query("t5_feed_home_away_splits", f"""
  SELECT season, team_code, team_name, coalesce(hg, 0) AS home_games, {ratio0('hw', 'hg')} * 100 AS home_win_pct, {_v('hf', 'hg')} AS home_ortg, {_v('ha', 'hg')} AS home_drtg,
    {_v('hf', 'hg')} - {_v('ha', 'hg')} AS home_net, coalesce(ag, 0) AS away_games, {ratio0('aw', 'ag')} * 100 AS away_win_pct, {_v('af', 'ag')} AS away_ortg,
    {_v('aa', 'ag')} AS away_drtg, {_v('af', 'ag')} - {_v('aa', 'ag')} AS away_net,
    ({_v('hf', 'hg')} - {_v('ha', 'hg')}) - ({_v('af', 'ag')} - {_v('aa', 'ag')}) AS home_adv_diff
  FROM ({_T2}) LEFT JOIN ({_VEN}) USING (season, team_code)""")
def _(lg):
    eff = T.feed_efficiency(A.team_feed(lg.box), A.team_feed(lg.box, opponents=True))
    return T.feed_home_away_splits(lg.games, eff)


@query("t6_referee_records", """
  SELECT *, games - wins AS losses, wins / games * 100 AS win_pct FROM (
    SELECT season, team_code, referee, count(*) AS games, count(*) FILTER (won) AS wins FROM (
      SELECT season, unnest([referee1, referee2, referee3]) AS referee, home_team AS team_code, home_score > away_score AS won FROM games WHERE played
      UNION ALL SELECT season, unnest([referee1, referee2, referee3]), away_team, away_score > home_score FROM games WHERE played)
    WHERE referee IS NOT NULL GROUP BY 1, 2, 3) WHERE games >= 3""")
def _(lg):
    return T.referee_records(lg.games)


@query("t7_close_games", f"""
  SELECT t.season, t.team_code, team_name, total_games, total_wins, avg_point_diff, total_wins / total_games * 100 AS overall_win_pct, cg AS close_games_played,
    cw AS close_wins, cg - cw AS close_losses, {ratio('cw', 'cg')} * 100 AS close_win_pct, coalesce({ratio('lw', 'lg')} * 100, 50e0) AS league_avg_close_win_pct
  FROM (SELECT season, team_code, count(*) AS total_games, count(*) FILTER ({_WON}) AS total_wins, avg(pts_for - pts_against) AS avg_point_diff,
          count(*) FILTER (abs(pts_for - pts_against) <= 5) AS cg, count(*) FILTER (abs(pts_for - pts_against) <= 5 AND {_WON}) AS cw
        FROM team_games WHERE played AND pts_for IS NOT NULL GROUP BY 1, 2) t
  JOIN (SELECT season, count(*) FILTER (abs(pts_for - pts_against) <= 5) AS lg, count(*) FILTER (abs(pts_for - pts_against) <= 5 AND {_WON}) AS lw
        FROM team_games WHERE played AND pts_for IS NOT NULL GROUP BY 1) l USING (season) LEFT JOIN teams USING (team_code)""")
def _(lg):
    return T.close_games(lg.games, lg.teams)


@query("t8_current_standings", f"""
  SELECT *, wins + losses AS games_played FROM (SELECT season, team_code, count(*) FILTER (played AND {_WON}) AS wins,
    count(*) FILTER (played AND pts_for < pts_against) AS losses FROM team_games GROUP BY 1, 2)""")
def _(lg):
    return T.current_standings(lg.games)


def _ff(fgm2, fga2, fgm3, fga3, fta, orb, odrb, tov, pace):
    fga = f"({fga2} + {fga3})"
    return f"""{ratio0(f'{fgm2} * 2 + {fgm3} * 3', f'{fga} * 2')} AS efg_pct, {ratio0(f'{tov} * 100', f'{fga} * 100 + {fta} * 44 + {tov} * 100')} AS tov_pct,
    {ratio0(orb, f'{orb} + {odrb}')} AS orb_pct, {ratio0(fta, fga)} AS ft_rate, {pace} AS pace, {ratio0(fga3, fga)} AS three_pt_rate"""


_TG = """SELECT season, gamecode, team_code, sum(fgm2) AS fgm2, sum(fga2) AS fga2, sum(fgm3) AS fgm3, sum(fga3) AS fga3, sum(fta) AS fta, sum(off_rebounds) AS orb,
    sum(def_rebounds) AS drb, sum(turnovers) AS tov, sum(possessions) AS poss FROM adv WHERE seconds > 0 GROUP BY 1, 2, 3"""
_FF = f"""SELECT season, team_code, {_ff('fgm2', 'fga2', 'fgm3', 'fga3', 'fta', 'orb', 'odrb', 'tov', ratio0('poss', 'games'))}
  FROM (SELECT t.season, t.team_code, sum(t.fgm2) AS fgm2, sum(t.fga2) AS fga2, sum(t.fgm3) AS fgm3, sum(t.fga3) AS fga3, sum(t.fta) AS fta, sum(t.orb) AS orb,
          sum(t.tov) AS tov, sum(t.poss) AS poss, sum(o.drb) AS odrb, count(DISTINCT t.gamecode) AS games
        FROM ({_TG}) t JOIN team_games s USING (season, gamecode, team_code) JOIN ({_TG}) o ON o.season = t.season AND o.gamecode = t.gamecode AND o.team_code = s.opponent
        GROUP BY 1, 2)"""


@query("t9_four_factors", f"SELECT season, team_code, efg_pct, tov_pct, orb_pct, ft_rate, round(pace, 6) AS pace, three_pt_rate FROM ({_FF})")
def _(lg):
    return rounded(T.four_factors(lg.adv, lg.games), "pace")


@query("t10_feed_four_factors", f"""
  SELECT o.season, o.team_code, {_ff('o.twoPointersMade', 'o.twoPointersAttempted', 'o.threePointersMade', 'o.threePointersAttempted', 'o.freeThrowsAttempted',
    'o.offensiveRebounds', 'd.defensiveRebounds', 'o.turnovers', ratio0('o.po', 'o.gp'))}
  FROM (SELECT *, {_FP} AS po FROM ({_OFF})) o JOIN ({_OPP}) d USING (season, team_code)""")
def _(lg):
    return T.feed_four_factors(A.team_feed(lg.box), A.team_feed(lg.box, opponents=True))


def _monthly(weight: str) -> str:
    return f"""
  SELECT b.season, b.team_code, b.month, mi AS month_index, games, home_game_ratio, coalesce(opp_strength_avg, 0e0) AS opp_strength_avg,
    CASE WHEN poss > 0 THEN pf / poss * 100 ELSE 0e0 END AS ortg, CASE WHEN poss > 0 THEN pa / poss * 100 ELSE 0e0 END AS drtg,
    CASE WHEN poss > 0 THEN pf / poss * 100 ELSE 0e0 END - CASE WHEN poss > 0 THEN pa / poss * 100 ELSE 0e0 END AS net_rtg,
    coalesce(ts_pct, 0e0) AS ts_pct, {ratio0('poss', 'games')} AS pace
  FROM mbase b LEFT JOIN (
    SELECT d.season, d.team_code, d.month, avg(onet) AS opp_strength_avg FROM dated d LEFT JOIN (
      SELECT season, team_code AS opponent, sum(pf) / nullif(sum({weight}), 0) * 100 - sum(pa) / nullif(sum({weight}), 0) * 100 AS onet FROM mbase GROUP BY 1, 2) s
      ON s.season = d.season AND s.opponent = d.opponent GROUP BY 1, 2, 3) f ON f.season = b.season AND f.team_code = b.team_code AND f.month = b.month
  WHERE mi IS NOT NULL"""


_MPRE = f"""WITH dated AS (SELECT *, month(game_day) AS month, {MONTH} AS mi FROM team_games WHERE played AND game_day IS NOT NULL),
  mbase AS (SELECT season, team_code, month, any_value(mi) AS mi, count(*) AS games, CAST(sum(pts_for) AS BIGINT) AS pf, CAST(sum(pts_against) AS BIGINT) AS pa,
      avg(CASE WHEN is_home THEN 1e0 ELSE 0e0 END) AS home_game_ratio, any_value(poss) AS poss, any_value(ts_pct) AS ts_pct
    FROM dated JOIN (SELECT a.season, a.team_code, month(g.game_day) AS month, sum(possessions) AS poss, avg(ts_pct) AS ts_pct
      FROM adv a JOIN games g USING (season, gamecode) WHERE seconds > 0 AND g.played AND g.game_day IS NOT NULL GROUP BY 1, 2, 3) p USING (season, team_code, month) GROUP BY 1, 2, 3)"""
_MCOLS = ["opp_strength_avg", "ortg", "drtg", "net_rtg", "ts_pct", "pace"]
_MR = ", ".join(f"round({c}, 6) AS {c}" for c in _MCOLS)


@query("t11_monthly_form", f"SELECT season, team_code, month, month_index, games, home_game_ratio, {_MR} FROM ({_MPRE} {_monthly('poss')})")
def _(lg):
    return rounded(T.monthly_form(lg.adv, lg.games), *_MCOLS)


@query("t11_monthly_form_fanout", f"SELECT season, team_code, month, month_index, games, home_game_ratio, {_MR} FROM ({_MPRE} {_monthly('poss * games')})")
def _(lg):
    return rounded(T.monthly_form(lg.adv, lg.games, fanout_compat=True), *_MCOLS)


@query("t12_form_features", f"""
  SELECT team_code, month_index, round(coalesce(k.h, t.h), 6) AS home_game_ratio, round(coalesce(k.o, t.o), 6) AS opp_strength_avg
  FROM (SELECT team_code, avg(home_game_ratio) AS h, avg(opp_strength_avg) AS o FROM ({_MPRE} {_monthly('poss')}) GROUP BY 1) t CROSS JOIN range(1, 9) r(month_index)
  LEFT JOIN (SELECT team_code, month_index, avg(home_game_ratio) AS h, avg(opp_strength_avg) AS o FROM ({_MPRE} {_monthly('poss')}) GROUP BY 1, 2) k
    USING (team_code, month_index)""")
def _(lg):
    return rounded(T.form_features(T.monthly_form(lg.adv, lg.games)), "home_game_ratio", "opp_strength_avg")


@query("t13_form_insights", f"""
  SELECT *, CASE WHEN feb_mar_diff < -1 THEN 'slump' WHEN feb_mar_diff > 1 THEN 'surge' END AS feb_mar_label,
    CASE WHEN apr_may_diff < -1 THEN 'drop-off' WHEN apr_may_diff > 1 THEN 'surge' END AS apr_may_label
  FROM (SELECT team_code, num_seasons, round(a, 6) AS season_avg, round(f - a, 6) AS feb_mar_diff, round(m - a, 6) AS apr_may_diff FROM (
    SELECT team_code, avg(x) AS a, avg(x) FILTER (month_index IN (5, 6)) AS f, avg(x) FILTER (month_index IN (7, 8)) AS m FROM (
      SELECT team_code, month_index, avg(net_rtg) AS x FROM ({_MPRE} {_monthly('poss')}) GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT team_code, count(DISTINCT season) AS num_seasons FROM ({_MPRE} {_monthly('poss')}) GROUP BY 1) USING (team_code))""")
def _(lg):
    monthly = T.monthly_form(lg.adv, lg.games)
    curve = monthly.groupBy("team_code", "month_index").agg(F.avg("net_rtg").alias("x_net_rtg"))
    return rounded(T.form_insights(monthly, curve).drop("insight"), "season_avg", "feb_mar_diff", "apr_may_diff")


_DW = """WITH days AS (SELECT DISTINCT season, team_code, game_day FROM team_games WHERE played AND game_day IS NOT NULL),
  dw AS (SELECT a.season, a.team_code, a.game_day AS d1, b.game_day AS d2, b.game_day - a.game_day AS day_gap FROM days a JOIN days b
    ON a.season = b.season AND a.team_code = b.team_code AND b.game_day > a.game_day AND b.game_day - a.game_day BETWEEN 2 AND 4
    WHERE NOT EXISTS (SELECT 1 FROM days m WHERE m.season = a.season AND m.team_code = a.team_code AND m.game_day > a.game_day AND m.game_day < b.game_day)),
  dwg AS (SELECT dw.season, dw.team_code, x.gamecode AS gc1, y.gamecode AS gc2, day_gap FROM dw
    JOIN team_games x ON x.season = dw.season AND x.team_code = dw.team_code AND x.game_day = d1 AND x.played
    JOIN team_games y ON y.season = dw.season AND y.team_code = dw.team_code AND y.game_day = d2 AND y.played)"""


@query("t14_double_week_pairs", f"SELECT * FROM ({_DW} SELECT * FROM dwg)")
def _(lg):
    return T.double_week_pairs(lg.games)


_U = "CASE WHEN possessions <> 0 THEN ((fga2 + fga3) * 100 + fta * 44 + (turnovers + assists) * 100 + fouls_received * 100) / 100e0 / possessions END"


@query("t14_double_week_fatigue", f"""
  SELECT season, age_bracket, metric, round(g1, 6) AS game1_avg, round(g2, 6) AS game2_avg, round(g2 - g1, 6) AS drop,
    round(CASE WHEN g1 <> 0 THEN (g2 - g1) / g1 * 100 ELSE 0e0 END, 6) AS drop_pct, n AS sample_size
  FROM (SELECT season, age_bracket, metric, avg(v1) AS g1, avg(v2) AS g2, least(count(v1), count(v2)) AS n FROM (
    {_DW}, ln AS (SELECT season, gamecode, team_code, player_id, ts_pct, {_U} AS usg, CAST(plus_minus AS DOUBLE) AS pm FROM adv WHERE seconds > 300),
    jn AS (SELECT d.season, p.age_bracket, a.ts_pct AS t1, a.usg AS u1, a.pm AS p1, b.ts_pct AS t2, b.usg AS u2, b.pm AS p2 FROM dwg d
      JOIN ln a ON a.season = d.season AND a.gamecode = d.gc1 AND a.team_code = d.team_code
      JOIN ln b ON b.season = d.season AND b.gamecode = d.gc2 AND b.team_code = d.team_code AND b.player_id = a.player_id
      JOIN player_dim p ON p.player_id = a.player_id WHERE p.birthdate IS NOT NULL)
    SELECT season, age_bracket, 'TS%' AS metric, t1 AS v1, t2 AS v2 FROM jn UNION ALL SELECT season, age_bracket, 'Usage Rate', u1, u2 FROM jn
    UNION ALL SELECT season, age_bracket, 'Plus/Minus', p1, p2 FROM jn) GROUP BY 1, 2, 3) WHERE n > 0""")
def _(lg):
    return rounded(T.double_week_fatigue(lg.games, lg.adv, lg.players, _as_of()), "game1_avg", "game2_avg", "drop", "drop_pct")


@query("t15_matchup_vulnerability", """
  SELECT * FROM (SELECT season, team_code, archetype, description, CASE WHEN wn >= 10 THEN wp / wn * 100 END AS with_drtg, CASE WHEN tn - wn >= 10 THEN (tp - wp) / (tn - wn) * 100 END AS without_drtg,
      CASE WHEN wn >= 10 THEN wp / wn * 100 END - CASE WHEN tn - wn >= 10 THEN (tp - wp) / (tn - wn) * 100 END AS drtg_diff, with_events
    FROM (SELECT season, team_code, archetype, description, count(*) AS with_events, sum(pf) AS wp, sum(tp0) AS wn FROM (
        SELECT DISTINCT s.season, s.opponent AS team_code, s.gamecode, s.p, s.pf, s.tp AS tp0, archetype FROM (SELECT *, unnest(lineup) AS player_id FROM sided) s
          JOIN archetypes a USING (player_id) WHERE a.height IS NOT NULL AND archetype IS NOT NULL)
      JOIN (VALUES ('Tall Playmaker','Guard > 195 cm'), ('Standard Guard','Guard <= 195 cm'), ('Stretch Big','Center > 200 cm'), ('Undersized Big','Center <= 200 cm'),
        ('Tall Forward','Forward > 205 cm'), ('Standard Forward','Forward <= 205 cm')) v(archetype, description) USING (archetype) GROUP BY 1, 2, 3, 4) w
    JOIN (SELECT season, opponent AS team_code, sum(pf) AS tp, sum(tp) AS tn FROM sided GROUP BY 1, 2) t USING (season, team_code))
  WHERE drtg_diff IS NOT NULL AND with_events >= 30""")
def _(lg):
    return T.matchup_vulnerability(lg.totals, lg.players)


_RATES = f"""{ratio0("(sum(fga2 + fga3) * 100 + sum(fta) * 44 + (sum(turnovers) + sum(assists)) * 100 + sum(fouls_received) * 100) / 100e0", "sum(possessions)")} AS true_usg_pct,
    {ratio0("sum(steals + blocks_favour + def_rebounds)", "sum(possessions)")} AS stop_rate, {ratio0("sum(assists)", "sum(possessions)")} AS assist_ratio,
    {ratio0("sum(fga3)", "sum(fga2 + fga3)")} AS three_pt_rate, {ratio0("sum(fta)", "sum(fga2 + fga3)")} AS ft_rate"""
_TGT = f"""
  SELECT s.*, d.height, CAST(d.birthdate AS VARCHAR) AS birthdate, d.position, d.country, d.age, o.on_net_rtg, o.off_net_rtg, o.on_off_diff, team_name
  FROM (SELECT season, player_id, team_code, max(player_name) AS player_name, count(DISTINCT gamecode) AS games, avg(minutes) AS minutes_pg, avg(points) AS points_pg,
      sum(seconds) / 60e0 AS total_minutes, avg(ts_pct) AS ts_pct, avg(off_rating) AS off_rating, {_RATES}, avg(total_rebounds) AS rebounds_pg, avg(assists) AS assists_pg, avg(steals) AS steals_pg
    FROM adv WHERE seconds > 0 GROUP BY 1, 2, 3) s LEFT JOIN teams t ON t.team_code = s.team_code LEFT JOIN player_dim d ON d.player_id = s.player_id
  LEFT JOIN season_onoff o ON o.season = s.season AND o.player_id = s.player_id AND o.team = s.team_code"""
_TC = ["season", "player_id", "team_code", "player_name", "games", "total_minutes", "three_pt_rate", "ft_rate", "height", "position", "country", "age", "team_name", "points_pg", "rebounds_pg", "assists_pg", "steals_pg"]
_TR = ["minutes_pg", "ts_pct", "off_rating", "true_usg_pct", "stop_rate", "assist_ratio", "on_net_rtg", "off_net_rtg", "on_off_diff"]
_TSEL = ", ".join(_TC + [f"round({c}, 6) AS {c}" for c in _TR])


def _targets(lg):
    return T.scout_targets(lg.adv, lg.teams, lg.players, lg.season_on_off, _as_of())


@query("t16_scout_targets", f"SELECT birthdate, {_TSEL} FROM ({_TGT})")
def _(lg):
    return rounded(_targets(lg).withColumn("birthdate", F.col("birthdate").cast("string")), *_TR)


_POOL = f"""
  SELECT *, CASE WHEN big > 18 AND big > guard * 1.3e0 THEN 'Center' WHEN guard > 14 AND guard > big * 1.1e0 THEN 'Guard' ELSE 'Forward' END AS position
  FROM (SELECT *, (orb_pct + drb_pct) * 50 + blocks_pg * 10 AS big, assist_ratio * 50 + three_pt_rate * 50 AS guard FROM (
    SELECT season, player_id AS player_code, player_name AS player_name_raw, a.team_code, t.team_name, {display('player_name')} AS player_name, count(DISTINCT gamecode) AS games_played,
      avg(minutes) AS minutes_pg, avg(points) AS points_pg, avg(ts_pct) AS ts_pct, avg(off_rating) AS off_rating, avg(steals) AS steals_pg, avg(blocks_favour) AS blocks_pg,
      avg(assists) AS assists_pg, avg(total_rebounds) AS rebounds_pg, {_RATES}, {ratio0('sum(assists)', 'sum(turnovers)')} AS ast_tov_ratio,
      {ratio0('sum(off_rebounds)', 'sum(total_rebounds)')} AS orb_pct, {ratio0('sum(def_rebounds)', 'sum(total_rebounds)')} AS drb_pct
    FROM adv a LEFT JOIN teams t ON t.team_code = a.team_code WHERE seconds > 0 GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT gamecode) >= 10))"""
_PR = ["minutes_pg", "ts_pct", "off_rating", "true_usg_pct", "stop_rate", "assist_ratio"]
_PC = ["season", "player_code", "player_name_raw", "team_code", "team_name", "player_name", "games_played", "points_pg", "steals_pg", "blocks_pg", "assists_pg", "rebounds_pg",
       "three_pt_rate", "ft_rate", "ast_tov_ratio", "orb_pct", "drb_pct", "position"]
_PSEL = ", ".join(_PC + [f"round({c}, 6) AS {c}" for c in _PR])


@query("t17_scouting_pool", f"SELECT {_PSEL} FROM ({_POOL})")
def _(lg):
    return rounded(T.scouting_pool(lg.adv, lg.teams), *_PR)


@query("t18_on_off_table", "SELECT season, player_id, team, games, on_net_rtg, off_net_rtg, on_off_diff FROM season_onoff WHERE team = 'FEN'")
def _(lg):
    return T.on_off_table(lg.season_on_off, team_code="FEN").select("season", "player_id", "team", "games", "on_net_rtg", "off_net_rtg", "on_off_diff")


_DELTA = ["ortg", "drtg", "pace", "net_rtg"]
_DAVG = ", ".join(f"avg({c}) OVER (PARTITION BY season) AS {c}_avg, {c} - avg({c}) OVER (PARTITION BY season) AS {c}_delta" for c in _DELTA)
_DR = [f"{c}_{s}" for c in _DELTA for s in ("avg", "delta")]


@query("t19_pace_quadrants", f"""
  SELECT season, team_code, {', '.join(f'round({c}, 6) AS {c}' for c in _DR)},
    CASE WHEN pace_delta > 0 AND net_rtg_delta > 0 THEN 'Fast & Efficient' WHEN NOT pace_delta > 0 AND net_rtg_delta > 0 THEN 'Slow & Efficient'
         WHEN pace_delta > 0 THEN 'Fast & Inefficient' ELSE 'Slow & Inefficient' END AS quadrant FROM (SELECT season, team_code, {_DAVG} FROM eff)""")
def _(lg):
    return rounded(T.pace_quadrants(lg.efficiency), *_DR)


_SIT = ["pts_from_2pt_pct", "pts_from_3pt_pct", "pts_from_ft_pct", "steals_pg", "turnovers_pg", "off_reb_pg", "assists_pg"]


@query("t19_situational_deltas", f"""
  SELECT season, team_code, {', '.join(f'round(avg({c}) OVER (PARTITION BY season), 6) AS {c}_avg, round({c} - avg({c}) OVER (PARTITION BY season), 6) AS {c}_delta' for c in _SIT)}
  FROM (SELECT season, team_code, sum(fgm2 * 2) / sum(points) * 100 AS pts_from_2pt_pct, sum(fgm3 * 3) / sum(points) * 100 AS pts_from_3pt_pct,
    sum(ftm) / sum(points) * 100 AS pts_from_ft_pct, sum(steals) / count(DISTINCT gamecode) AS steals_pg, sum(turnovers) / count(DISTINCT gamecode) AS turnovers_pg,
    sum(off_rebounds) / count(DISTINCT gamecode) AS off_reb_pg, sum(assists) / count(DISTINCT gamecode) AS assists_pg FROM adv WHERE points > 0 GROUP BY 1, 2)""")
def _(lg):
    return rounded(T.league_deltas(T.situational_scoring(lg.adv), _SIT), *[f"{c}_{s}" for c in _SIT for s in ("avg", "delta")])


@query("t20_scout_kpis", f"""
  SELECT season, count(*) AS players, round(avg(age), 6) AS avg_age, round(avg(ts_pct), 6) AS avg_ts_pct, round(avg(on_off_diff), 6) AS avg_on_off_diff FROM ({_TGT}) GROUP BY 1""")
def _(lg):
    return rounded(T.scout_kpis(_targets(lg)), "avg_age", "avg_ts_pct", "avg_on_off_diff")


# -- filters over the scouting tables -----------------------------------------
@query("f5_scout_filter", f"""
  SELECT season, player_id, team_code, games, age, height FROM ({_TGT}) WHERE age BETWEEN 22 AND 34 AND height BETWEEN 185 AND 215
    AND CASE position WHEN 'guard' THEN 'Guard' WHEN 'G' THEN 'Guard' WHEN 'Center' THEN 'Center' ELSE 'Forward' END IN ('Guard', 'Center')
    AND minutes_pg >= 10 AND games >= 5 AND (ts_pct IS NULL OR ts_pct >= 0.3e0) AND (true_usg_pct IS NULL OR true_usg_pct <= 1.5e0)""")
def _(lg):
    return FL.scout_filter(
        _targets(lg), ["Guard", "Center"], (22, 34), (185, 215), min_minutes=10, min_games=5, min_ts=30, max_usg=1.5
    ).select("season", "player_id", "team_code", "games", "age", "height")


@query("f11_similarity_pool_filter", f"SELECT season, player_code, team_code FROM ({_POOL}) WHERE minutes_pg >= 15 AND position = 'Forward'")
def _(lg):
    return FL.similarity_pool_filter(T.scouting_pool(lg.adv, lg.teams), 15, "Forward").select("season", "player_code", "team_code")


@query("o3_ordered_scout_table", f"SELECT season, player_id, team_code, games, points_pg FROM ({_TGT})")
def _(lg):
    return O.order_table(_targets(lg), "on_off_diff").select("season", "player_id", "team_code", "games", "points_pg")


@query("f6_team_season_shots", "SELECT season, gamecode, team, player, id_action, action, points, coord_x, coord_y, zone, minute FROM shots WHERE team IN ('PAO', 'PAN')")
def _(lg):
    return FL.team_season_shots(lg.shots, "PAO").select(
        "season", "gamecode", "team", "player", "id_action", "action", "points", "coord_x", "coord_y", "zone", "minute")


@query("f8_season_schedule", """
  SELECT season, gamecode, round, home_team AS home_code, away_team AS away_code, h.team_name AS home_name, a.team_name AS away_name, h.logo_url AS home_logo,
    a.logo_url AS away_logo, 'Round ' || round AS round_label,
    h.team_name || ' ' || CASE WHEN played AND home_score IS NOT NULL THEN home_score || '-' || away_score ELSE 'vs' END || ' ' || a.team_name AS matchup
  FROM games LEFT JOIN teams h ON h.team_code = home_team LEFT JOIN teams a ON a.team_code = away_team""")
def _(lg):
    return FL.season_schedule(lg.games, lg.teams).select(
        "season", "gamecode", "round", "home_code", "away_code", "home_name", "away_name", "home_logo", "away_logo", "round_label", "matchup")


@query("f8_round_bounds", "SELECT season, min(round) FILTER (NOT played) AS upcoming_round, max(round) FILTER (played) AS last_played_round FROM fixtures GROUP BY 1")
def _(lg):
    return FL.round_bounds(lg.fixtures)


@query("f9_remaining_games", "SELECT season, gamecode, home_team, away_team, round FROM fixtures WHERE NOT played")
def _(lg):
    return FL.remaining_games(lg.fixtures)


@query("f10_has_officials", "SELECT season, bool_or(referee1 IS NOT NULL) AS has_referees FROM games GROUP BY 1")
def _(lg):
    return FL.has_officials(lg.games)


@query("o4_team_games", "SELECT season, gamecode, round, played, team_code, opponent, is_home, pts_for, pts_against FROM team_games")
def _(lg):
    return T.team_games(lg.games).drop("game_day")


@query("o5_team_universe", "SELECT DISTINCT season, team_code FROM team_games")
def _(lg):
    return T.team_universe(lg.games)


# -- schedule windows ---------------------------------------------------------
@query("w1_recent_form", """
  SELECT t.season, t.gamecode, t.team_code, t.is_home, t.round, coalesce(avg(p.d), 0e0) AS form FROM team_games t LEFT JOIN LATERAL (
    SELECT pts_for - pts_against AS d FROM team_games q WHERE q.season = t.season AND q.team_code = t.team_code AND q.played AND q.pts_for IS NOT NULL AND q.round < t.round
    ORDER BY q.round DESC, q.gamecode DESC LIMIT 5) p ON TRUE GROUP BY 1, 2, 3, 4, 5""")
def _(lg):
    return W.recent_form(lg.games)


_REST = """
  SELECT t.season, t.gamecode, t.team_code, t.is_home, t.round, CASE WHEN any_value(t.game_day) IS NULL THEN 3 WHEN count(q.gamecode) = 0 THEN 7 WHEN max(q.game_day) IS NULL THEN 3
    ELSE greatest(any_value(t.game_day) - max(q.game_day), 0) END AS rest_days
  FROM team_games t LEFT JOIN team_games q ON q.season = t.season AND q.team_code = t.team_code AND q.played AND q.round < t.round GROUP BY 1, 2, 3, 4, 5"""


@query("w2_rest_days", _REST)
def _(lg):
    return W.rest_days(lg.games)


@query("w2_rest_days_latest", "SELECT season, team_code, CASE WHEN max(game_day) FILTER (played) IS NULL THEN 3 ELSE greatest(DATE '2025-06-30' - max(game_day) FILTER (played), 0) END AS rest_days FROM team_games GROUP BY 1, 2")
def _(lg):
    return W.rest_days_latest(lg.games, F.to_date(F.lit("2025-06-30")))


def _pctl(c: str) -> str:
    r = f"(rank() OVER (PARTITION BY season ORDER BY {c}) + (count(*) OVER (PARTITION BY season, {c}) - 1) / 2e0) / count(*) OVER (PARTITION BY season) * 100"
    return f"{'100 - ' if c == 'tov_pct' else ''}{r} AS {c}_pctl"


_F6 = ["efg_pct", "tov_pct", "orb_pct", "ft_rate", "three_pt_rate", "pace"]


@query("w5_percentile_ranks", f"SELECT season, team_code, {', '.join(map(_pctl, _F6))} FROM (SELECT * REPLACE (round(pace, 6) AS pace) FROM ({_FF}))")
def _(lg):
    df = W.percentile_ranks(rounded(T.four_factors(lg.adv, lg.games), "pace"), _F6)
    return df.select("season", "team_code", *[f"{c}_pctl" for c in _F6])


_LABEL = "CASE month(game_day) " + " ".join(f"WHEN {m} THEN '{t}'" for m, t in ((10, "Oct"), (11, "Nov"), (12, "Dec"), (1, "Jan"), (2, "Feb"), (3, "Mar"), (4, "Apr"), (5, "May"))) + " END"


@query("x9_month_labels", f"SELECT season, {_LABEL} AS month, count(*) AS games FROM games GROUP BY 1, 2")
def _(lg):
    return lg.games.groupBy("season", X.month_label(F.month("game_day")).alias("month")).agg(F.count(F.lit(1)).alias("games"))


@query("x20_rating_tiers", """
  SELECT season, team_code, CASE WHEN net > 8 THEN 'Elite' WHEN net > 3 THEN 'Strong' WHEN net > -3 THEN 'Average' WHEN net > -8 THEN 'Weak' ELSE 'Poor' END AS tier, round(100 - abs(ortg - drtg), 6) AS balance
  FROM (SELECT season, team_code, round(net_rtg, 6) AS net, ortg, drtg FROM eff)""")
def _(lg):
    """Tier of a team's net rating, and how even its offense and defense are."""
    df = rounded(lg.efficiency, "net_rtg").select("season", "team_code", X.net_rating_tier("net_rtg").alias("tier"), X.balance_score("ortg", "drtg").alias("balance"))
    return rounded(df, "balance")
