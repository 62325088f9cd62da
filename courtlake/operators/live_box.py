"""Player statistics of a running game from its plays, kept as sums that micro-batches add to.

``play_counts`` of some plays and ``add_counts`` of any number of such tables give the same as ``play_counts`` of all plays, in
whatever order and slices they come; ``live_boxscore`` reads a boxscore off them at any time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.functions import exprs as X

PLAYER = [*C.GAME_KEYS, "team_code", "player_id"]
#: Which plays each statistic counts.
COUNTED = {
    "fgm2": ["2FGM"], "fga2": ["2FGM", "2FGA"], "fgm3": ["3FGM"], "fga3": ["3FGM", "3FGA"], "ftm": ["FTM"], "fta": ["FTM", "FTA"],
    "off_rebounds": ["O"], "def_rebounds": ["D"], "total_rebounds": ["O", "D"], "assists": ["AS"], "steals": ["ST"], "turnovers": ["TO"],
    "blocks_favour": ["FV"], "blocks_against": ["AG"], "fouls_committed": [*C.FOUL_PLAYS, "OF"], "fouls_received": ["RV"],
}
COUNTS = (
    "season INT, gamecode INT, team_code STRING, player_id STRING, player_name STRING, points BIGINT, "
    + ", ".join(f"{c} BIGINT" for c in COUNTED) + ", clock INT, subs ARRAY<STRUCT<n: INT, enters: BOOLEAN, at: INT>>"
)


def play_counts(plays: DataFrame) -> DataFrame:
    """Per game and player: counts, the substitutions, and the game time of the last play with a clock. Plays without a player are one row
    of the game, for their clock."""
    at = F.when(F.coalesce("markertime", F.lit("")) != "", X.elapsed_seconds("period", "clock_secs").cast("int"))
    sub = F.col("playtype").isin("IN", "OUT") & F.col("player_id").isNotNull()
    change = F.struct(F.col(C.PLAY_ORDER).cast("int").alias("n"), (F.col("playtype") == "IN").alias("enters"), at.alias("at"))
    rows = plays.withColumns({"team_code": F.when(F.col("player_id").isNotNull(), F.col("codeteam"))})
    return rows.groupBy(*PLAYER).agg(
        F.max("player").alias("player_name"), F.sum(X.points_of("playtype")).alias("points"),
        *[X.count_of("playtype", *codes).alias(c) for c, codes in COUNTED.items()],
        F.max(at).alias("clock"), F.collect_list(F.when(sub, change)).alias("subs"),
    )


def add_counts(*parts: DataFrame) -> DataFrame:
    """The counts of all plays from those of disjoint sets of plays. Rows without a player have a null key, which groups as any other."""
    rows = reduce(DataFrame.unionByName, [p.select(*PLAYER, "player_name", "points", *COUNTED, "clock", "subs") for p in parts])
    return rows.groupBy(*PLAYER).agg(
        F.max("player_name").alias("player_name"), *[F.sum(c).alias(c) for c in ("points", *COUNTED)],
        F.max("clock").alias("clock"), F.flatten(F.collect_list("subs")).alias("subs"),
    )


def live_boxscore(counts: DataFrame) -> DataFrame:
    """Boxscore rows of the plays so far.

    A player is on court from the start if his first substitution takes him off, or if he has plays but no substitution; from
    each IN to his next substitution; and to the last play's time if none follows. ``plus_minus`` and ``is_home`` are not known
    from counts.
    """
    now = counts.groupBy(*C.GAME_KEYS).agg(F.max("clock").alias("now"))
    rows = counts.where("player_id IS NOT NULL").join(now, C.GAME_KEYS).withColumn("s", F.array_sort("subs"))
    ends = F.expr("zip_with(s, concat(slice(transform(s, x -> x.at), 2, size(s)), array(now)), (x, e) -> CASE WHEN x.enters THEN e - x.at ELSE 0 END)")
    first = F.expr("CASE WHEN size(s) = 0 THEN now WHEN NOT s[0].enters THEN s[0].at ELSE 0 END")
    seconds = F.greatest(F.aggregate(ends, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))) + F.coalesce(first, F.lit(0)), F.lit(0))
    out = rows.withColumns({
        "seconds": seconds.cast("int"), "is_home": F.lit(None).cast("int"), "plus_minus": F.lit(None).cast("int"),
    })
    return out.withColumn("minutes", F.col("seconds") / 60.0).select(*C.GAME_KEYS, "player_id", "player_name", "team_code", "is_home", "seconds", "minutes", *C.COUNT_STATS)
