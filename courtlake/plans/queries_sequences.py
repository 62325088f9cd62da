"""Play-by-play, lineup, clutch and shot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlake import config as C
from courtlake.operators import box as B, clutch as K, lineups as L, playmaking as P, ranking as O, sequences as S
from courtlake.plans.oracle_base import POSS, PTS, display, ratio, ratio0
from courtlake.plans.registry import joined_text, query, rounded

_G = "season, gamecode"


# -- lineups ------------------------------------------------------------------
@query("l1_lineup_tracking", f"SELECT {_G}, true_numberofplay, playtype, home_team, away_team, array_to_string(home_lineup, ',') AS home_lineup, array_to_string(away_lineup, ',') AS away_lineup FROM lu")
def _(lg):
    df = L.lineup_events(lg.tagged, lg.segment_lineups)
    return joined_text(df, "home_lineup", "away_lineup").select(
        "season", "gamecode", "true_numberofplay", "playtype", "home_team", "away_team", "home_lineup", "away_lineup")


_NAMES = f"SELECT season, player_id, {display('max_by(player_name, (gamecode, player_name))')} AS name FROM box GROUP BY 1, 2"


@query("l2_lineup_stats", f"""
  SELECT s.season, s.team, array_to_string(s.lineup, ',') AS lineup, events, pts_for, pts_against, poss, ortg, drtg, net_rtg, lineup_str
  FROM lineup_stats s JOIN (SELECT season, lineup, string_agg(name, ', ' ORDER BY name) AS lineup_str
    FROM (SELECT DISTINCT season, lineup, unnest(lineup) AS player_id FROM lineup_stats) JOIN ({_NAMES}) USING (season, player_id) GROUP BY 1, 2) n
    ON n.season = s.season AND n.lineup = s.lineup""")
def _(lg):
    return joined_text(L.lineup_stats(lg.totals, L.player_names(lg.box)), "lineup")


def _combos(size: int) -> str:
    extra = ", unnest(lineup) AS c" if size == 3 else ""
    cond = "a < b AND b < c" if size == 3 else "a < b"
    combo = "a || ',' || b || ',' || c" if size == 3 else "a || ',' || b"
    inner = "SELECT *, unnest(lineup) AS c FROM (SELECT *, unnest(lineup) AS b FROM (SELECT *, unnest(lineup) AS a FROM sided))" if size == 3 else \
        "SELECT *, unnest(lineup) AS b FROM (SELECT *, unnest(lineup) AS a FROM sided)"
    net = lambda d, e: f"{d} / greatest({e} / 10e0, 1e0) * 100"
    return f"""
  SELECT {_G}, team, combo, events_together, {net('d', 'events_together')} AS net_rtg_together, {net('(ad - d)', '(ae - events_together)')} AS net_rtg_apart,
    {net('d', 'events_together')} - {net('(ad - d)', '(ae - events_together)')} AS synergy
  FROM (SELECT {_G}, team, {combo} AS combo, count(*) AS events_together, CAST(sum(pf - pa) AS BIGINT) AS d FROM ({inner}) WHERE {cond} GROUP BY 1, 2, 3, 4)
  JOIN (SELECT {_G}, team, count(*) AS ae, CAST(sum(pf - pa) AS BIGINT) AS ad FROM sided GROUP BY 1, 2, 3) USING (season, gamecode, team) WHERE events_together >= 5"""


@query("l3_duo_synergy", _combos(2))
def _(lg):
    return joined_text(L.combo_synergy(lg.totals, 2), "combo")


@query("l3_trio_synergy", _combos(3))
def _(lg):
    return joined_text(L.combo_synergy(lg.totals, 3), "combo")


def _stints(ot: int) -> str:
    start = f"CASE WHEN period <= 4 THEN (period - 1) * 600 ELSE 2400 + (period - 5) * {ot} END"
    length = f"CASE WHEN period <= 4 THEN 600 ELSE {ot} END"
    return f"""
  WITH pl AS (SELECT *, last_value(CASE WHEN coalesce(points_a, 0) > 0 OR coalesce(points_b, 0) > 0 THEN p END IGNORE NULLS)
        OVER (PARTITION BY season, gamecode, period ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vp, {PTS} AS made,
        coalesce(points_a, 0) AS a, coalesce(points_b, 0) AS b FROM pbp),
  base AS (SELECT season, gamecode, period, any_value(home_team) AS home_team,
      coalesce(min_by(CASE WHEN codeteam = home_team THEN greatest(a - made, 0) ELSE a END, p) FILTER (a > 0 OR b > 0), 0) AS ba,
      coalesce(min_by(CASE WHEN codeteam = home_team THEN b ELSE greatest(b - made, 0) END, p) FILTER (a > 0 OR b > 0), 0) AS bb,
      max_by(a, p) FILTER (a > 0 OR b > 0) AS fa, max_by(b, p) FILTER (a > 0 OR b > 0) AS fb FROM pl GROUP BY 1, 2, 3),
  acts AS (SELECT x.season, x.gamecode, x.period, x.codeteam AS team, x.player_id, x.p, x.playtype, x.clock_secs, v.a AS na, v.b AS nb
    FROM pl x LEFT JOIN pl v ON v.season = x.season AND v.gamecode = x.gamecode AND v.p = x.vp WHERE x.player_id IS NOT NULL AND x.codeteam IS NOT NULL),
  fs AS (SELECT season, gamecode, period, team, min(p) AS fsub FROM acts WHERE playtype IN ('IN', 'OUT') GROUP BY 1, 2, 3, 4),
  seen AS (SELECT s.*, (r.player_id IS NOT NULL AND (f.fsub IS NULL OR s.fact < f.fsub)) AS early FROM (
      SELECT season, gamecode, period, team, player_id, min(p) AS fact, max_by(playtype, p) FILTER (playtype IN ('IN', 'OUT')) AS lsub FROM acts GROUP BY 1, 2, 3, 4, 5) s
    LEFT JOIN fs f USING (season, gamecode, period, team) LEFT JOIN box r ON r.season = s.season AND r.gamecode = s.gamecode AND r.team_code = s.team AND r.player_id = s.player_id),
  fnd AS (SELECT season, gamecode, period, team, count(*) FILTER (early) AS n FROM seen GROUP BY 1, 2, 3, 4),
  st AS (SELECT season, gamecode, period, team, player_id FROM seen JOIN fnd USING (season, gamecode, period, team)
    WHERE period > 1 AND CASE WHEN n >= 5 THEN early ELSE coalesce(lsub = 'OUT', FALSE) OR (early AND lsub IS NULL) END
    UNION ALL SELECT season, gamecode, 1, team_code, player_id FROM box WHERE is_starter = 1),
  lg AS (SELECT season, gamecode, period, team, player_id, -1 AS o, 'IN' AS mv, {start} AS sec, ba AS a, bb AS b FROM st JOIN base USING (season, gamecode, period)
    UNION ALL SELECT season, gamecode, period, team, player_id, p, playtype, {start} + {length} - clock_secs, coalesce(na, ba), coalesce(nb, bb)
      FROM acts JOIN base USING (season, gamecode, period) WHERE playtype IN ('IN', 'OUT')),
  nx AS (SELECT *, lead(mv) OVER w AS nmv, lead(sec) OVER w AS nat, lead(a) OVER w AS ea, lead(b) OVER w AS eb FROM lg WINDOW w AS (PARTITION BY season, gamecode, period, team, player_id ORDER BY o)),
  iv AS (SELECT n.season, n.gamecode, n.team, n.player_id, n.sec AS start_sec, CASE WHEN nmv = 'OUT' THEN nat ELSE {start} + {length} END AS end_sec, n.period,
      (CASE WHEN nmv = 'OUT' THEN ea ELSE coalesce(fa, ba) END - n.a) - (CASE WHEN nmv = 'OUT' THEN eb ELSE coalesce(fb, bb) END - n.b) AS d, home_team
    FROM nx n JOIN base USING (season, gamecode, period) WHERE mv = 'IN' AND (nmv IS NULL OR nmv = 'OUT'))
  SELECT i.season, i.gamecode, i.team, i.player_id, n.player_name, start_sec, end_sec, end_sec - start_sec AS duration_sec,
    CASE WHEN i.team = home_team THEN d ELSE -d END AS plus_minus, period
  FROM iv i LEFT JOIN box_names n ON n.season = i.season AND n.gamecode = i.gamecode AND n.player_id = i.player_id AND n.team_code = i.team WHERE end_sec > start_sec"""


@query("l4_player_stints", f"SELECT * FROM ({_stints(300)})")
def _(lg):
    return L.player_stints(lg.pbp, lg.box)


@query("l4_player_stints_long_overtime", f"SELECT * FROM ({_stints(600)})")
def _(lg):
    return L.player_stints(lg.pbp, lg.box, ot_seconds=600)


@query("l5_stint_summary", f"""
  SELECT {_G}, team, player_id, player_name, sum(duration_sec) / 60e0 AS total_min, count(*) AS stints, avg(duration_sec) / 60e0 AS avg_stint_min, CAST(sum(plus_minus) AS BIGINT) AS total_pm
  FROM ({_stints(300)}) GROUP BY 1, 2, 3, 4, 5""")
def _(lg):
    return L.stint_summary(L.player_stints(lg.pbp, lg.box))


@query("l6_on_off_splits", "SELECT * FROM onoff")
def _(lg):
    return lg.on_off


@query("l7_season_on_off", "SELECT * FROM season_onoff")
def _(lg):
    return lg.season_on_off


# -- runs ---------------------------------------------------------------------
_RUNS = f"""SELECT *, {PTS} AS pts, lag(codeteam) OVER (PARTITION BY season, gamecode ORDER BY p) AS prev FROM pbp WHERE playtype IN ('2FGM', '3FGM', 'FTM')"""
_ISL = f"""SELECT *, sum(CASE WHEN prev IS NULL OR prev <> codeteam THEN 1 ELSE 0 END) OVER (PARTITION BY season, gamecode ORDER BY p) AS isl FROM ({_RUNS})"""


def _stoppers(src: str, least: int) -> str:
    return f"""
  WITH isl AS ({_ISL.replace('FROM pbp', 'FROM ' + src)}),
  agg AS (SELECT season, gamecode, isl, any_value(codeteam) AS team, CAST(sum(pts) AS BIGINT) AS run_points, min(p) AS p0 FROM isl GROUP BY 1, 2, 3)
  SELECT a.season, a.gamecode, a.team AS run_team, a.run_points, x.codeteam AS stopper_team, x.player AS stopper_player, x.player_id AS stopper_player_id,
    x.playtype AS stopper_playtype, x.period, x.markertime, x.true_numberofplay AS stop_play
  FROM agg a JOIN agg b ON b.season = a.season AND b.gamecode = a.gamecode AND b.isl = a.isl + 1 JOIN isl x ON x.season = b.season AND x.gamecode = b.gamecode AND x.p = b.p0
  WHERE a.run_points >= {least}"""


@query("l8_run_stoppers", f"SELECT * FROM ({_stoppers('pbp', 8)})")
def _(lg):
    return S.run_stoppers(lg.pbp)


_LIVE = "SELECT b.* FROM pbp b JOIN games g USING (season, gamecode) WHERE NOT g.played"


RUN_HISTORY = f"SELECT * FROM ({_stoppers('pbp', 8)})"


@query("l8b_live_run_history", f"SELECT * FROM ({_stoppers(f'({_LIVE})', 8)})")
def _(lg):
    live = lg.games.filter(~F.col("played")).select("season", "gamecode")
    return S.run_stoppers(lg.pbp.join(live, C.GAME_KEYS, "left_semi"))


ACTIVE_RUN = f"""
  WITH isl AS ({_ISL}), last AS (SELECT season, gamecode, max(isl) AS isl FROM isl GROUP BY 1, 2)
  SELECT {_G}, codeteam AS run_team, CAST(sum(pts) AS BIGINT) AS run_points, abs(min_by(clock_secs, p) - max_by(clock_secs, p)) AS duration_secs,
    string_agg(player || ' (' || playtype || ')', '; ' ORDER BY p) AS scoring_plays, any_value(CASE WHEN codeteam = home_team THEN away_team ELSE home_team END) AS opponent_team
  FROM isl JOIN last USING (season, gamecode, isl) GROUP BY 1, 2, 3 HAVING sum(pts) >= 4""".replace("WITH isl", "SELECT * FROM (WITH isl") + ")"


@query("l9_active_run", ACTIVE_RUN)
def _(lg):
    return S.active_run(lg.pbp)


@query("l10_foul_trouble", f"""
  SELECT {_G}, team, star_player_id, star_player, second_foul_play_num, foul_period, fb / pb * 100 AS ortg_before, fa / pa * 100 AS ortg_after, ab / pb * 100 AS drtg_before,
    aa / pa * 100 AS drtg_after, fa / pa * 100 - fb / pb * 100 AS ortg_impact, aa / pa * 100 - ab / pb * 100 AS drtg_impact
  FROM (SELECT s.season, s.gamecode, s.team, star_player_id, star_player, f.tn AS second_foul_play_num, f.period AS foul_period,
      sum(CASE WHEN x.true_numberofplay < f.tn AND x.codeteam = s.team THEN {PTS} ELSE 0 END) AS fb, sum(CASE WHEN x.true_numberofplay >= f.tn AND x.codeteam = s.team THEN {PTS} ELSE 0 END) AS fa,
      sum(CASE WHEN x.true_numberofplay < f.tn AND x.codeteam <> s.team THEN {PTS} ELSE 0 END) AS ab, sum(CASE WHEN x.true_numberofplay >= f.tn AND x.codeteam <> s.team THEN {PTS} ELSE 0 END) AS aa,
      greatest(count(*) FILTER (x.true_numberofplay < f.tn AND x.codeteam = s.team AND {POSS}), 1) AS pb, greatest(count(*) FILTER (x.true_numberofplay >= f.tn AND x.codeteam = s.team AND {POSS}), 1) AS pa
    FROM (SELECT {_G}, team_code AS team, player_id AS star_player_id, player_name AS star_player FROM (
        SELECT *, row_number() OVER (PARTITION BY season, gamecode, team_code ORDER BY fga2 + fga3 + fta DESC, player_id) AS rk FROM box) WHERE rk = 1) s
    JOIN (SELECT {_G}, player_id, true_numberofplay AS tn, period, row_number() OVER (PARTITION BY season, gamecode, player_id ORDER BY p) AS n FROM pbp
        WHERE playtype IN ('CM', 'CMU', 'CMT') AND period <= 2) f ON f.season = s.season AND f.gamecode = s.gamecode AND f.player_id = s.star_player_id AND f.n = 2
    JOIN pbp x ON x.season = s.season AND x.gamecode = s.gamecode GROUP BY 1, 2, 3, 4, 5, 6, 7)""")
def _(lg):
    return S.foul_trouble_impact(lg.pbp, lg.box)


_MOM = f"""SELECT {_G}, true_numberofplay AS play_number, period, markertime AS time, clock_secs, points_a AS home_score, points_b AS away_score, points_a - points_b AS score_diff,
    codeteam AS scoring_team, player, playtype AS play_type FROM pbp WHERE playtype IN ('2FGM', '3FGM', 'FTM')"""


@query("l11_momentum_timeline", _MOM)
def _(lg):
    return S.momentum_timeline(lg.pbp)


_LEFT = "greatest(CASE WHEN period <= 4 THEN 2400 - ((period - 1) * 600 + 600 - clock_secs) ELSE clock_secs END, 0)"


@query("l12_win_probability", f"""
  SELECT {_G}, play_number, period, time, home_score, away_score, round(wp, 9) AS home_wp, round(1 - wp, 9) AS away_wp FROM (
    SELECT *, greatest(0.001e0, least(0.999e0, 1 / (1 + exp(-0.15e0 * ((home_score - away_score + 3 * f) / greatest(sqrt(f), 0.1e0)))))) AS wp
    FROM (SELECT *, greatest({_LEFT} / 2400e0, 0.01e0) AS f FROM ({_MOM})))""")
def _(lg):
    return S.win_probability_timeline(lg.pbp).withColumns({c: F.round(c, 9) for c in ("home_wp", "away_wp")})


@query("l13_current_lineups", f"""
  SELECT l.season, l.gamecode, l.team, l.is_home AS side, array_to_string(l.lineup, ',') AS lineup, coalesce(events, 0) AS events, coalesce(f, 0) AS pts_for, coalesce(a, 0) AS pts_against,
    coalesce(f / n * 100, 0e0) AS ortg, coalesce(a / n * 100, 0e0) AS drtg, coalesce(f / n * 100 - a / n * 100, 0e0) AS net_rtg
  FROM (SELECT {_G}, team, is_home, max_by(lineup, p) AS lineup FROM sided GROUP BY 1, 2, 3, 4) l
  LEFT JOIN (SELECT {_G}, team, lineup, count(*) AS events, CAST(sum(pf) AS BIGINT) AS f, CAST(sum(pa) AS BIGINT) AS a, greatest((sum(tp) + sum(op)) / 2e0, 1e0) AS n
    FROM sided WHERE len(lineup) = 5 GROUP BY 1, 2, 3, 4) s ON s.season = l.season AND s.gamecode = l.gamecode AND s.team = l.team AND s.lineup = l.lineup""")
def _(lg):
    return joined_text(L.current_lineups(lg.totals), "lineup")


_LIVE_SCORE = f"""
  SELECT {_G}, max(points_a) AS home_score, max(points_b) AS away_score, max(period) AS period, max_by(markertime, p) AS time_remaining,
    max_by(CASE WHEN period <= 4 THEN (period - 1) * 600 + 600 - clock_secs ELSE 2400 + (period - 5) * 300 + 300 - clock_secs END, p) AS total_seconds_elapsed,
    max_by({_LEFT}, p) AS total_seconds_remaining FROM pbp GROUP BY 1, 2"""


@query("l14_live_score", _LIVE_SCORE)
def _(lg):
    return S.live_score(lg.pbp)


# -- clutch -------------------------------------------------------------------
_CCOLS = ["season", "gamecode", "true_numberofplay", "playtype", "player_id", "codeteam", "period", "clock_secs"]


@query("f1_clutch_plays", f"SELECT {', '.join(_CCOLS)} FROM clutch")
def _(lg):
    return K.clutch_plays(lg.pbp).select(*_CCOLS)


@query("f1_clutch_plays_zero_fill", f"SELECT {', '.join(_CCOLS)} FROM pbp WHERE period >= 4 AND clock_secs <= 300 AND abs(coalesce(points_a, 0) - coalesce(points_b, 0)) <= 5")
def _(lg):
    return K.clutch_plays(lg.pbp, score_fill="zero").select(*_CCOLS)


@query("f2_clutch_shots", "SELECT season, gamecode, num_anot, id_player, id_action, points FROM shots WHERE minute >= 36 AND abs(points_a - points_b) <= 5")
def _(lg):
    return K.clutch_shots(lg.shots).select("season", "gamecode", "num_anot", "id_player", "id_action", "points")


_CC = """count(*) FILTER (playtype IN ('2FGM','2FGA','3FGM','3FGA')) AS {p}fga, count(*) FILTER (playtype IN ('FTM','FTA')) AS {p}fta, count(*) FILTER (playtype = 'TO') AS {p}turnovers"""


@query("c1_clutch_stats", f"""
  SELECT c.season, c.gamecode, c.player_id, n.pn AS player_name, c.team, clutch_actions, clutch_points, clutch_fga, clutch_fta, clutch_turnovers,
    {ratio('clutch_points * 50', 'clutch_fga * 100 + clutch_fta * 44')} AS clutch_ts_pct,
    {ratio('clutch_fga * 100 + clutch_fta * 44 + clutch_turnovers * 100', 'g_fga * 100 + g_fta * 44 + g_turnovers * 100')} AS clutch_usage
  FROM (SELECT {_G}, player_id, min(codeteam) AS team, count(*) AS clutch_actions, CAST(sum({PTS}) AS BIGINT) AS clutch_points, {_CC.format(p='clutch_')} FROM clutch WHERE player_id IS NOT NULL GROUP BY 1, 2, 3) c
  JOIN (SELECT {_G}, {_CC.format(p='g_')} FROM clutch GROUP BY 1, 2) g USING (season, gamecode)
  LEFT JOIN (SELECT {_G}, player_id, min(player_name) AS pn FROM box GROUP BY 1, 2, 3) n ON n.season = c.season AND n.gamecode = c.gamecode AND n.player_id = c.player_id""")
def _(lg):
    return K.clutch_stats(K.clutch_plays(lg.pbp), lg.box)


_CB = {"fgm2": "'2FGM'", "fga2": "'2FGM','2FGA'", "fgm3": "'3FGM'", "fga3": "'3FGM','3FGA'", "ftm": "'FTM'", "fta": "'FTM','FTA'", "off_rebounds": "'O'", "def_rebounds": "'D'",
       "total_rebounds": "'O','D'", "assists": "'AS'", "steals": "'ST'", "turnovers": "'TO'", "blocks_favour": "'FV'", "fouls_committed": "'CM','CMU','CMT'", "fouls_received": "'RV'"}
_CBOX = f"""
  SELECT c.season, c.gamecode, c.player_id, player_name, team_code, is_home, is_starter, is_playing, c.seconds // 60 || ':' || lpad(CAST(c.seconds % 60 AS VARCHAR), 2, '0') AS minutes_str,
    c.seconds, c.seconds / 60e0 AS minutes, {', '.join('c.' + n for n in _CB)}, c.points, 0 AS blocks_against, 0 AS plus_minus
  FROM (SELECT {_G}, player_id, greatest(max(clock_secs) - min(clock_secs), 30) AS seconds, CAST(sum({PTS}) AS BIGINT) AS points,
      {', '.join(f'count(*) FILTER (playtype IN ({v})) AS {n}' for n, v in _CB.items())} FROM clutch WHERE player_id IS NOT NULL GROUP BY 1, 2, 3) c
  JOIN box b ON b.season = c.season AND b.gamecode = c.gamecode AND b.player_id = c.player_id"""


@query("c2_clutch_boxscore", _CBOX)
def _(lg):
    return K.clutch_boxscore(K.clutch_plays(lg.pbp), lg.box)


@query("c3_clutch_bundle_advanced", f"""
  WITH cb AS ({_CBOX}), tp AS (SELECT {_G}, team_code, (sum(fga2 + fga3) * 100 + sum(fta) * 44 - sum(off_rebounds) * 100 + sum(turnovers) * 100) / 100e0 AS poss, sum(seconds) AS secs FROM cb GROUP BY 1, 2, 3)
  SELECT season, gamecode, player_id, points, poss * (CAST(seconds AS DOUBLE) / secs) AS possessions, {ratio('points * 50', '(fga2 + fga3) * 100 + fta * 44')} AS ts_pct
  FROM cb JOIN tp USING (season, gamecode, team_code)""".replace("WITH cb", "SELECT * FROM (WITH cb") + ")")
def _(lg):
    from courtlake.plans.bundle import clutch_bundle

    return clutch_bundle(lg)["advanced_stats"].select("season", "gamecode", "player_id", "points", "possessions", "ts_pct")


@query("c3_clutch_bundle_lineups", f"""
  SELECT season, team, array_to_string(lineup, ',') AS lineup, count(*) AS events, CAST(sum(pf) AS BIGINT) AS pts_for, CAST(sum(pa) AS BIGINT) AS pts_against,
    greatest((sum(tp) + sum(op)) / 2e0, 1e0) AS poss FROM sided JOIN (SELECT {_G}, p FROM clutch) USING (season, gamecode, p) WHERE len(lineup) = 5 GROUP BY 1, 2, 3""")
def _(lg):
    from courtlake.plans.bundle import clutch_bundle

    return joined_text(clutch_bundle(lg)["lineup_stats"].select("season", "team", "lineup", "events", "pts_for", "pts_against", "poss"), "lineup")


# -- playmaking and shots -----------------------------------------------------
@query("p1_assist_pairs", "SELECT * FROM pairs")
def _(lg):
    return lg.pairs


@query("p2_assist_network", f"""
  SELECT {_G}, passer_id AS assister_id, passer_name AS assister_name, shooter_id AS scorer_id, shooter_name AS scorer_name, team, count(*) AS count,
    string_agg(DISTINCT play_type, ', ' ORDER BY play_type) AS play_types FROM pairs GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def _(lg):
    return P.assist_network(lg.pairs)


@query("p3_assist_matrix", "SELECT season, team, passer_id, shooter_id, count(*) AS count FROM pairs GROUP BY ALL")
def _(lg):
    return P.assist_matrix(lg.pairs)


@query("p3_assist_value_matrix", "SELECT season, team, passer_id, shooter_id, round(sum(xp), 6) AS xp FROM links GROUP BY ALL")
def _(lg):
    return rounded(P.assist_matrix(lg.links, "xp"), "xp")


_LCOLS = "season, gamecode, assist_play, passer_id, shooter_id, team, shot_value, play_type, num_anot, coord_x, coord_y, zone, xp"


@query("p4_assist_shot_links", f"SELECT {_LCOLS} FROM links")
def _(lg):
    return lg.links.select(*_LCOLS.split(", "))


@query("p5_baseline_xp", "SELECT season, gamecode, num_anot, CASE WHEN shot_value = 3 THEN CASE WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 680 THEN 0.37e0 ELSE 0.35e0 END "
       "WHEN coord_x IS NULL THEN 0.5e0 WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 150 THEN 0.65e0 WHEN sqrt(coord_x * coord_x + (coord_y - 72) * (coord_y - 72)) < 300 THEN 0.42e0 "
       "ELSE 0.38e0 END * shot_value AS xp FROM shots WHERE id_action NOT IN ('FTM', 'FTA')")
def _(lg):
    from courtlake.functions import exprs as X

    return P.field_goals(lg.shots).select("season", "gamecode", "num_anot", X.baseline_xp("coord_x", "coord_y", "shot_value").alias("xp"))


@query("p6_passer_quality", "SELECT season, passer_id, passer_name, team, count(*) AS total_assists, round(avg(xp), 6) AS aaq FROM links GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3")
def _(lg):
    return rounded(P.passer_quality(lg.links, min_assists=3), "aaq")


@query("p6_finisher_quality", "SELECT season, shooter_id, shooter_name, team, count(*) AS assisted_shots, round(sum(xp), 6) AS axp_total, round(avg(xp), 6) AS axp_avg FROM links GROUP BY 1, 2, 3, 4")
def _(lg):
    return rounded(P.finisher_quality(lg.links), "axp_total", "axp_avg")


@query("p6_duo_quality", "SELECT season, passer_id, passer_name, shooter_id, shooter_name, team, count(*) AS assists, round(sum(xp), 6) AS duo_xp FROM links GROUP BY 1, 2, 3, 4, 5, 6")
def _(lg):
    return rounded(P.duo_quality(lg.links), "duo_xp")


_SQ = ["avg_expected_pts", "total_expected_pts", "shot_quality_diff"]


@query("p7_shot_quality", """
  SELECT season, id_player, player, team, count(*) AS total_shots, CAST(sum(made) AS BIGINT) AS makes, CAST(sum(points) AS BIGINT) AS actual_pts, round(avg(e), 6) AS avg_expected_pts,
    round(coalesce(sum(e), 0), 6) AS total_expected_pts, sum(made) / count(*) AS fg_pct, round(sum(points) - coalesce(sum(e), 0), 6) AS shot_quality_diff
  FROM shots LEFT JOIN (SELECT season, zone, sum(made) / count(*) * avg(shot_value) AS e FROM shots WHERE zone IS NOT NULL GROUP BY 1, 2) USING (season, zone) GROUP BY 1, 2, 3, 4""")
def _(lg):
    return rounded(P.shot_quality(lg.shots), *_SQ)


_FGS = "SELECT * FROM shots WHERE id_action NOT IN ('FTM', 'FTA')"


@query("f7_field_goals", f"SELECT season, gamecode, num_anot, id_player, id_action, CASE WHEN points > 0 THEN 'Made' ELSE 'Missed' END AS outcome FROM ({_FGS})")
def _(lg):
    return P.field_goals(lg.shots).select("season", "gamecode", "num_anot", "id_player", "id_action", "outcome")


@query("p8_shooting_summary", f"""
  SELECT *, {ratio0('made', 'attempts')} AS fg_pct, {ratio0('fgm2', 'fga2')} AS fg2_pct, {ratio0('fgm3', 'fga3')} AS fg3_pct FROM (
    SELECT {_G}, id_player, player, team, count(*) AS attempts, count(*) FILTER (points > 0) AS made, count(*) FILTER (id_action LIKE '2%') AS fga2,
      count(*) FILTER (id_action LIKE '2%' AND points > 0) AS fgm2, count(*) FILTER (id_action LIKE '3%') AS fga3, count(*) FILTER (id_action LIKE '3%' AND points > 0) AS fgm3
    FROM ({_FGS}) WHERE coord_x IS NOT NULL AND coord_y IS NOT NULL GROUP BY 1, 2, 3, 4, 5)""")
def _(lg):
    return P.shooting_summary(lg.shots)


@query("p8_zone_summary", f"SELECT {_G}, zone, count(*) AS shots, count(*) FILTER (points > 0) AS made, count(*) FILTER (points > 0) / count(*) AS fg_pct FROM ({_FGS}) GROUP BY 1, 2, 3")
def _(lg):
    return P.zone_summary(lg.shots)


@query("p9_shot_density", f"SELECT season, team, CAST(floor(coord_x / 50) AS BIGINT) AS bin_x, CAST(floor(coord_y / 50) AS BIGINT) AS bin_y, count(*) AS shots FROM ({_FGS}) WHERE coord_x IS NOT NULL GROUP BY 1, 2, 3, 4")
def _(lg):
    return P.shot_density(lg.shots)


# -- best and worst tables ----------------------------------------------------
def _ends(src: str, keys: str, measure: str, ties: str, best: int, worst: int, cols: str) -> str:
    rn = lambda d: f"row_number() OVER (PARTITION BY {keys} ORDER BY {measure} {d}, {ties})"
    return f"""
  SELECT {cols}, rank, 'best' AS "end" FROM (SELECT *, {rn('DESC')} AS rank FROM ({src})) WHERE rank <= {best}
  UNION ALL SELECT {cols}, rank, 'worst' FROM (SELECT *, {rn('ASC')} AS rank FROM ({src})) WHERE rank <= {worst}"""


@query("o2_best_worst_lineups", _ends("SELECT season, team, array_to_string(lineup, ',') AS lu_text, events, net_rtg FROM lineup_stats WHERE events >= 20", "season", "net_rtg", "lu_text, team", 5, 5, "season, team, lu_text, events, net_rtg"))
def _(lg):
    stats = L.lineup_stats(lg.totals, min_events=20).select("season", "team", F.array_join("lineup", ",").alias("lu_text"), "events", "net_rtg")
    return O.best_and_worst(stats, ["season"], "net_rtg", ["lu_text", "team"], 5, 5)


@query("o2_best_worst_duos", _ends(f"SELECT * FROM ({_combos(2)}) WHERE events_together >= 10", "season, gamecode", "synergy", "combo", 10, 5, "season, gamecode, team, combo, synergy"))
def _(lg):
    duo = joined_text(L.combo_synergy(lg.totals, 2).filter("events_together >= 10"), "combo")
    return O.best_and_worst(duo.select("season", "gamecode", "team", "combo", "synergy"), ["season", "gamecode"], "synergy", ["combo"], 10, 5)


@query("o2_top_on_off", f"SELECT {_G}, team, player_id, on_off_diff, rank FROM (SELECT *, row_number() OVER (PARTITION BY season, gamecode ORDER BY on_off_diff DESC, player_id) AS rank FROM onoff) WHERE rank <= 3")
def _(lg):
    return O.top_n(lg.on_off, ["season", "gamecode"], [F.desc("on_off_diff"), F.col("player_id")], 3).select(
        "season", "gamecode", "team", "player_id", "on_off_diff", "rank")


# -- team season bundle -------------------------------------------------------
@query("b7_team_season_bundle", f"""
  SELECT season, team, array_to_string(lineup, ',') AS lineup, events, pts_for, pts_against, net_rtg FROM (
    SELECT season, team, lineup, count(*) AS events, CAST(sum(pf) AS BIGINT) AS pts_for, CAST(sum(pa) AS BIGINT) AS pts_against,
      sum(pf) / greatest((sum(tp) + sum(op)) / 2e0, 1e0) * 100 - sum(pa) / greatest((sum(tp) + sum(op)) / 2e0, 1e0) * 100 AS net_rtg
    FROM sided WHERE len(lineup) = 5 AND (team = 'OLY' OR opponent = 'OLY') GROUP BY 1, 2, 3) WHERE events >= 20""")
def _(lg):
    from courtlake.plans.bundle import team_season_bundle

    df = team_season_bundle(lg, "OLY")["lineup_season_stats"]
    return joined_text(df.select("season", "team", "lineup", "events", "pts_for", "pts_against", "net_rtg"), "lineup")
