"""On-court lineups from substitutions, and everything measured per lineup.

A lineup only changes at a substitution, so plays are numbered by the side's
running substitution count ("segment"). Players are assigned to segments, not to
plays; every statistic is first summed per segment and only then meets a lineup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X
from courtlake.functions.scans import BLOCK, block_of, join_per_key, running

SEGMENT_KEYS = ["season", "gamecode", "side", "seg"]
_FAN = 1024


def game_sides(box: DataFrame) -> DataFrame:
    return box.groupBy(*C.GAME_KEYS).agg(
        F.min(F.when(F.col("is_home") == 1, F.col("team_code"))).alias("home_team"),
        F.min(F.when(F.col("is_home") == 0, F.col("team_code"))).alias("away_team"),
    ).filter(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())


def player_names(box: DataFrame) -> DataFrame:
    """One display name per season and player, taken from the player's last game."""
    return box.groupBy("season", "player_id").agg(
        X.display_name(F.max_by("player_name", F.struct("gamecode", "player_name"))).alias("name")
    )


def tag_segments(pbp: DataFrame, box: DataFrame, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Plays with home and away team and each side's substitution count up to and including the play."""
    df = join_per_key(pbp, game_sides(box), C.GAME_KEYS, C.PLAY_ORDER, block)
    sub = F.col("playtype").isin("IN", "OUT") & F.col("player_id").isNotNull()
    flag = lambda team: F.when(sub & (F.col("codeteam") == F.col(team)), 1).otherwise(0)
    return running(
        df, C.GAME_KEYS, C.PLAY_ORDER,
        sums={"home_seg": flag("home_team"), "away_seg": flag("away_team")}, block=F.col(BLOCK),
    ).drop(BLOCK)


def segment_lineups(tagged: DataFrame, box: DataFrame) -> DataFrame:
    """Sorted lineup of every (game, side, segment).

    IN adds, OUT removes, both idempotent: a player is on court from an IN (or a
    start) until his next substitution row, whatever that row is.
    """
    keys = [*C.GAME_KEYS, "side", "player_id"]
    home = F.col("codeteam") == F.col("home_team")
    subs = tagged.filter(
        F.col("playtype").isin("IN", "OUT") & F.col("player_id").isNotNull()
        & (home | (F.col("codeteam") == F.col("away_team")))
    ).select(
        *C.GAME_KEYS, F.when(home, 1).otherwise(0).alias("side"), "player_id",
        F.when(home, F.col("home_seg")).otherwise(F.col("away_seg")).alias("seg"),
        (F.col("playtype") == "IN").alias("enters"),
    )
    starters = box.filter(F.col("is_starter") == 1).select(
        *C.GAME_KEYS, F.col("is_home").alias("side"), "player_id",
        F.lit(0).cast("bigint").alias("seg"), F.lit(True).alias("enters"),
    ).distinct()
    # A game's substitutions are already spread by player here, so a plain window will do.
    following = F.lead("seg").over(Window.partitionBy(*keys).orderBy("seg"))
    last_seg = tagged.groupBy(*C.GAME_KEYS).agg(F.max("home_seg").alias("h"), F.max("away_seg").alias("a"))
    spans = (
        starters.unionByName(subs).withColumn("next", following).filter("enters")
        .join(last_seg.hint("merge"), C.GAME_KEYS)
        .select(
            *keys, F.col("seg").alias("lo"),
            F.coalesce(F.col("next") - 1, F.when(F.col("side") == 1, F.col("h")).otherwise(F.col("a"))).alias("hi"),
        )
    )
    # Two-step fan-out keeps each generated array short however long a player stays on.
    fanned = spans.withColumn("b", F.explode(F.sequence(block_of("lo", _FAN), block_of("hi", _FAN)))).select(
        *C.GAME_KEYS, "side", "player_id",
        F.explode(F.sequence(F.greatest("lo", F.col("b") * _FAN), F.least("hi", F.col("b") * _FAN + (_FAN - 1)))).alias("seg"),
    )
    return fanned.groupBy(*SEGMENT_KEYS).agg(F.array_sort(F.collect_set("player_id")).alias("lineup"))


def lineup_events(tagged: DataFrame, lineups: DataFrame) -> DataFrame:
    """Plays with the sorted home and away lineups attached."""
    empty = F.array().cast("array<string>")
    side = lambda s, name: lineups.filter(F.col("side") == s).select(
        *C.GAME_KEYS, F.col("seg").alias(f"{name}_seg"), F.col("lineup").alias(f"{name}_lineup")
    )
    return (
        tagged.join(side(1, "home"), [*C.GAME_KEYS, "home_seg"], "left")
        .join(side(0, "away"), [*C.GAME_KEYS, "away_seg"], "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("home_lineup", "away_lineup")})
    )


def segment_totals(tagged: DataFrame, lineups: DataFrame) -> DataFrame:
    """Events, points and possessions for and against, per game, side and segment, with the lineup."""
    pts, poss = X.points_of("playtype"), X.is_possession("playtype").cast("int")
    of = lambda team, value: F.sum(F.when(F.col("codeteam") == F.col(team), value).otherwise(0))
    both = tagged.groupBy(*C.GAME_KEYS, "home_team", "away_team", "home_seg", "away_seg").agg(
        F.count("*").alias("events"), of("home_team", pts).alias("hp"), of("away_team", pts).alias("ap"),
        of("home_team", poss).alias("hn"), of("away_team", poss).alias("an"),
    )
    side = lambda flag, own, opp, seg, f, a, n, m: F.struct(
        F.lit(flag).alias("side"), F.col(own).alias("team"), F.col(opp).alias("opponent"), F.col(seg).alias("seg"),
        F.col(f).alias("pts_for"), F.col(a).alias("pts_against"), F.col(n).alias("team_poss"), F.col(m).alias("opp_poss"),
    )
    rows = both.select(*C.GAME_KEYS, "events", F.explode(F.array(
        side(1, "home_team", "away_team", "home_seg", "hp", "ap", "hn", "an"),
        side(0, "away_team", "home_team", "away_seg", "ap", "hp", "an", "hn"),
    )).alias("s")).select(*C.GAME_KEYS, "events", "s.*")
    sums = rows.groupBy(*SEGMENT_KEYS, "team", "opponent").agg(
        *[F.sum(c).alias(c) for c in ("events", "pts_for", "pts_against", "team_poss", "opp_poss")]
    )
    return sums.join(lineups.hint("merge"), SEGMENT_KEYS, "left").withColumn(
        "lineup", F.coalesce("lineup", F.array().cast("array<string>"))
    )


def _rates(poss, prefix: str = "") -> dict:
    p = F.col(poss) if isinstance(poss, str) else poss
    ortg, drtg = F.col(f"{prefix}pts_for") / p * 100, F.col(f"{prefix}pts_against") / p * 100
    return {f"{prefix}ortg": ortg, f"{prefix}drtg": drtg, f"{prefix}net_rtg": ortg - drtg}


def lineup_names(lineups: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``lineup_str``, the lineup's display names in alphabetical order."""
    text = (
        lineups.select("season", "lineup").distinct()
        .withColumn("player_id", F.explode("lineup"))
        .join(names, ["season", "player_id"], "left")
        .groupBy("season", "lineup")
        .agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("name", "player_id"))), ", ").alias("lineup_str"))
    )
    return lineups.join(text, ["season", "lineup"], "left")


def lineup_stats(totals: DataFrame, names: DataFrame | None = None, min_events: int = 0) -> DataFrame:
    """Five-man lineups per season and team: ratings per 100 possessions."""
    agg = (
        totals.filter(F.size("lineup") == 5)
        .groupBy("season", "team", "lineup")
        .agg(*[F.sum(c).alias(c) for c in ("events", "pts_for", "pts_against", "team_poss", "opp_poss")])
        .filter(F.col("events") >= min_events)
        .withColumn("poss", F.greatest((F.col("team_poss") + F.col("opp_poss")) / 2.0, F.lit(1.0)))
        .drop("team_poss", "opp_poss")
    )
    agg = agg.withColumns(_rates("poss"))
    return agg if names is None else lineup_names(agg, names)


def combinations(lineup: str, size: int):
    """Sorted pairs or triples of a sorted lineup array."""
    n = F.size(lineup)
    item = lambda i: F.get(lineup, i)
    span = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    if size == 2:
        return F.flatten(F.transform(span(F.lit(0), n - 2), lambda i: F.transform(
            span(i + 1, n - 1), lambda j: F.array(item(i), item(j)))))
    return F.flatten(F.flatten(F.transform(span(F.lit(0), n - 3), lambda i: F.transform(
        span(i + 1, n - 2), lambda j: F.transform(span(j + 1, n - 1), lambda k: F.array(item(i), item(j), item(k)))))))


def combo_synergy(totals: DataFrame, combo_size: int = 2, min_events: int = 5) -> DataFrame:
    """Net rating of 2 or 3 players together against the same team's other plays, per game.

    Possessions are events / 10. "Apart" is the team's total minus "together", so
    lineups are summed once before any combination is formed.
    """
    keys = [*C.GAME_KEYS, "team"]
    by_lineup = totals.groupBy(*keys, "lineup").agg(
        F.sum("events").alias("events"), F.sum(F.col("pts_for") - F.col("pts_against")).alias("diff")
    )
    whole = totals.groupBy(*keys).agg(
        F.sum("events").alias("all_events"), F.sum(F.col("pts_for") - F.col("pts_against")).alias("all_diff")
    )
    together = (
        by_lineup.withColumn("combo", F.explode(combinations("lineup", combo_size)))
        .groupBy(*keys, "combo")
        .agg(F.sum("events").alias("events_together"), F.sum("diff").alias("diff"))
        .filter(F.col("events_together") >= min_events)
    )
    net = lambda diff, events: diff / F.greatest(events / 10.0, F.lit(1.0)) * 100
    df = together.join(whole, keys).withColumns(
        {
            "net_rtg_together": net(F.col("diff"), F.col("events_together")),
            "net_rtg_apart": net(F.col("all_diff") - F.col("diff"), F.col("all_events") - F.col("events_together")),
        }
    )
    return df.select(
        *keys, "combo", "events_together", "net_rtg_together", "net_rtg_apart",
        (F.col("net_rtg_together") - F.col("net_rtg_apart")).alias("synergy"),
    )


_ON = ("events", "pts_for", "pts_against", "team_poss", "opp_poss")


def on_off_splits(totals: DataFrame, box: DataFrame) -> DataFrame:
    """Per game and player: team results with the player on and off court; off = team total - on."""
    keys = [*C.GAME_KEYS, "team"]
    by_lineup = totals.groupBy(*keys, "lineup").agg(*[F.sum(c).alias(c) for c in _ON])
    whole = totals.groupBy(*keys).agg(*[F.sum(c).alias(f"all_{c}") for c in _ON])
    on = (
        by_lineup.withColumn("player_id", F.explode("lineup"))
        .groupBy(*keys, "player_id")
        .agg(*[F.sum(c).alias(f"on_{c}") for c in _ON])
    )
    poss = lambda s: F.greatest((F.col(f"{s}_team_poss") + F.col(f"{s}_opp_poss")) / 2.0, F.lit(1.0))
    df = on.join(whole, keys).withColumns({f"off_{c}": F.col(f"all_{c}") - F.col(f"on_{c}") for c in _ON})
    df = df.withColumns({"on_poss": poss("on"), "off_poss": poss("off")})
    df = df.withColumns({**_rates("on_poss", "on_"), **_rates("off_poss", "off_")})
    names = box.groupBy(*C.GAME_KEYS, "player_id").agg(X.display_name(F.min("player_name")).alias("player_name"))
    return df.join(names, [*C.GAME_KEYS, "player_id"], "left").select(
        *C.GAME_KEYS, "team", "player_id", F.coalesce("player_name", "player_id").alias("player_name"),
        *[f"{s}_{c}" for s in ("on", "off") for c in ("events", "pts_for", "pts_against", "poss", "ortg", "drtg", "net_rtg")],
        (F.col("on_net_rtg") - F.col("off_net_rtg")).alias("on_off_diff"),
    )


def season_on_off(per_game: DataFrame) -> DataFrame:
    """Season sums per player and team (a transfer gives two rows); ratings from the exact sums."""
    sums = [f"{s}_{c}" for s in ("on", "off") for c in ("events", "pts_for", "pts_against", "poss")]
    agg = per_game.groupBy("season", "player_id", "team").agg(
        F.max_by("player_name", "gamecode").alias("player_name"), F.countDistinct("gamecode").alias("games"),
        *[F.sum(c).alias(c) for c in sums],
    )
    floor = lambda s: F.greatest(F.col(f"{s}_poss"), F.lit(1.0))
    agg = agg.withColumns({**_rates(floor("on"), "on_"), **_rates(floor("off"), "off_")})
    return agg.withColumn("on_off_diff", F.col("on_net_rtg") - F.col("off_net_rtg"))


def current_lineups(totals: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lineup on court at the last play of each game and side, with its rating in that game."""
    keys = [*C.GAME_KEYS, "team"]
    last = totals.groupBy(*keys).agg(F.max_by("lineup", "seg").alias("lineup"), F.first("side").alias("side"))
    unit = totals.filter(F.size("lineup") == 5).groupBy(*keys, "lineup").agg(*[F.sum(c).alias(c) for c in _ON])
    df = last.join(unit, [*keys, "lineup"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in _ON})
    df = df.withColumn("poss", F.greatest((F.col("team_poss") + F.col("opp_poss")) / 2.0, F.lit(1.0)))
    df = df.withColumns(_rates("poss")).drop("team_poss", "opp_poss", "poss")
    return df if names is None else lineup_names(df, names)


def player_stints(pbp: DataFrame, box: DataFrame, ot_seconds: int = 300, block: int = C.PLAYS_PER_BLOCK) -> DataFrame:
    """Continuous on-court stretches per period with the score change for the player's team.

    Starters of the first period come from the boxscore. Later periods list no
    starters: they are the roster players who act before the team's first
    substitution, and where fewer than five are found the period's OUT players
    (last substitution OUT) are added and its IN players removed.
    """
    pkeys = [*C.GAME_KEYS, "period"]
    tkeys = [*pkeys, "team"]
    sides = game_sides(box)
    plays = join_per_key(pbp, sides, C.GAME_KEYS, C.PLAY_ORDER, block)
    valid = (F.coalesce("points_a", F.lit(0)) > 0) | (F.coalesce("points_b", F.lit(0)) > 0)
    score = F.struct(F.coalesce("points_a", F.lit(0)).alias("a"), F.coalesce("points_b", F.lit(0)).alias("b"))
    made = X.points_of("playtype")
    at_home = F.col("codeteam") == F.col("home_team")
    base = plays.groupBy(*pkeys).agg(
        F.min_by(F.struct(
            F.when(at_home, F.greatest(F.col("points_a") - made, F.lit(0))).otherwise(F.coalesce("points_a", F.lit(0))).alias("a"),
            F.when(at_home, F.coalesce("points_b", F.lit(0))).otherwise(F.greatest(F.coalesce("points_b", F.lit(0)) - made, F.lit(0))).alias("b"),
        ), F.when(valid, F.col(C.PLAY_ORDER))).alias("base"),
        F.max_by(score, F.when(valid, F.col(C.PLAY_ORDER))).alias("final"),
    )
    zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    base = base.withColumn("base", F.coalesce("base", zero)).withColumn("final", F.coalesce("final", "base"))

    is_sub = F.col("playtype").isin("IN", "OUT")
    by_team = F.col("player_id").isNotNull() & (at_home | (F.col("codeteam") == F.col("away_team")))
    seen = plays.filter(by_team).groupBy(*pkeys, F.col("codeteam").alias("team"), "player_id").agg(
        F.min(C.PLAY_ORDER).alias("first_act"), F.min(F.when(is_sub, F.col(C.PLAY_ORDER))).alias("own_sub"),
        F.max_by("playtype", F.when(is_sub, F.col(C.PLAY_ORDER))).alias("last_sub"),
    )
    roster = box.select(*C.GAME_KEYS, F.col("team_code").alias("team"), "player_id", "is_starter").distinct()
    seen = seen.join(
        roster.select(*C.GAME_KEYS, "team", "player_id", F.lit(True).alias("rostered")), [*C.GAME_KEYS, "team", "player_id"], "left"
    )
    # One row per player and period: a window over a team's period holds its roster, not its plays.
    team = Window.partitionBy(*tkeys)
    early = F.col("rostered").isNotNull() & (F.col("first_sub").isNull() | (F.col("first_act") < F.col("first_sub")))
    later = (
        seen.withColumn("first_sub", F.min("own_sub").over(team)).withColumn("early", early)
        .withColumn("found", F.count_if("early").over(team))
        .filter(
            (F.col("period") > 1)
            & F.when(F.col("found") >= 5, F.col("early")).otherwise(
                F.coalesce(F.col("last_sub") == "OUT", F.lit(False)) | (F.col("early") & F.col("last_sub").isNull())
            )
        ).select(*tkeys, "player_id")
    )
    first = roster.filter(F.col("is_starter") == 1).select(*C.GAME_KEYS, F.lit(1).alias("period"), "team", "player_id")
    starts = later.unionByName(first).join(base, pkeys).select(
        *tkeys, "player_id", F.lit(-1).alias("ord"), F.lit("IN").alias("move"),
        X.period_start("period", ot_seconds).alias("at"), F.col("base").alias("score"), "final",
    )
    scored = running(
        plays.select(*pkeys, C.PLAY_ORDER, "playtype", "player_id", "codeteam", "clock_secs", "home_team", "away_team", "points_a", "points_b", BLOCK),
        pkeys, C.PLAY_ORDER, lasts={"now": F.when(valid, score)}, block=F.col(BLOCK),
    )
    moves = scored.filter(by_team & is_sub).join(base, pkeys).select(
        *pkeys, F.col("codeteam").alias("team"), "player_id", F.col(C.PLAY_ORDER).alias("ord"), F.col("playtype").alias("move"),
        X.elapsed_seconds("period", "clock_secs", ot_seconds).alias("at"), F.coalesce("now", "base").alias("score"), "final",
    )
    # A stint runs from an IN to the player's next row if that is an OUT, else to the period's end; a second IN restarts it.
    ahead = Window.partitionBy(*tkeys, "player_id").orderBy("ord")
    period_end = X.period_start("period", ot_seconds) + X.period_length("period", ot_seconds)
    closing = F.struct(F.lit("OUT").alias("move"), period_end.alias("at"), F.col("final").alias("score"))
    paired = (
        starts.unionByName(moves)
        .withColumn("close", F.coalesce(F.lead(F.struct("move", "at", "score")).over(ahead), closing))
        .filter((F.col("move") == "IN") & (F.col("close.move") == "OUT"))
        .select(*tkeys, "player_id", F.struct("at", "score").alias("open"), F.col("close.at").alias("at"), F.col("close.score").alias("score"))
    )
    home = F.col("team") == F.col("home_team")
    a = F.col("score.a") - F.col("open.score.a")
    b = F.col("score.b") - F.col("open.score.b")
    names = box.groupBy(*C.GAME_KEYS, F.col("team_code").alias("team"), "player_id").agg(
        X.display_name(F.min("player_name")).alias("player_name")
    )
    return (
        paired.join(sides, C.GAME_KEYS)
        .join(names, [*C.GAME_KEYS, "team", "player_id"], "left")
        .select(
            *C.GAME_KEYS, "team", "player_id", F.coalesce("player_name", "player_id").alias("player_name"),
            F.col("open.at").alias("start_sec"), F.col("at").alias("end_sec"),
            (F.col("at") - F.col("open.at")).alias("duration_sec"),
            F.when(home, a - b).otherwise(b - a).alias("plus_minus"), "period",
        )
        .filter(F.col("duration_sec") > 0)
    )


def stint_summary(stints: DataFrame) -> DataFrame:
    return stints.groupBy(*C.GAME_KEYS, "team", "player_id", "player_name").agg(
        (F.sum("duration_sec") / 60.0).alias("total_min"), F.count("*").alias("stints"),
        (F.avg("duration_sec") / 60.0).alias("avg_stint_min"), F.sum("plus_minus").alias("total_pm"),
    )
