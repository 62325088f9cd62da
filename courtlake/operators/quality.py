"""Data-quality jobs; every rule is an aggregate or an anti join over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C

_G = C.GAME_KEYS
REQUIRED_IDS = {
    "games": ["season", "gamecode", "home_team", "away_team"], "boxscores": ["season", "gamecode", "player_id", "team_code"],
    "play_by_play": ["season", "gamecode"], "shots": ["season", "gamecode"],
}


def orphan_games(tables: dict[str, DataFrame], games: DataFrame) -> DataFrame:
    """Games present in a detail table but missing from ``games``, counted per table (0 rows are reported too)."""
    known = games.select(*_G).distinct().withColumn("known", F.lit(True))
    parts = [
        t.select(*_G).distinct().join(known, _G, "left").agg(F.count_if(F.col("known").isNull()).alias("orphans"))
        .select(F.lit(name).alias("table_name"), "orphans")
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def null_identifiers(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and NULL count of every identifier column, one aggregate per table."""
    parts = []
    for name, cols in REQUIRED_IDS.items():
        agg = tables[name].agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        pairs = F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))]))
        parts.append(agg.select(F.lit(name).alias("table_name"), "rows", pairs.alias("column_name", "null_rows")))
    return reduce(DataFrame.unionByName, parts)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def _violations(df: DataFrame, keys: list, rules: dict) -> DataFrame:
    """Explode the failed rules of each row: one scan, no union."""
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(*keys, F.explode(failed).alias("rule"))


def boxscore_violations(box: DataFrame) -> DataFrame:
    """Games and player rows that break a boxscore rule."""
    per_row = _violations(box, [*_G, F.col("player_id").alias("subject")], {
        "fgm2>fga2": F.col("fgm2") > F.col("fga2"), "fgm3>fga3": F.col("fgm3") > F.col("fga3"), "ftm>fta": F.col("ftm") > F.col("fta"),
        "rebounds": F.col("total_rebounds") != F.col("off_rebounds") + F.col("def_rebounds"),
        "points": F.col("points") != F.col("fgm2") * 2 + F.col("fgm3") * 3 + F.col("ftm"),
        "negative points": F.col("points") < 0,
        "minutes": ~(F.col("minutes_str").contains(":") | (F.trim("minutes_str") == "DNP")),
        "home flag": ~F.col("is_home").isin(0, 1),
    })
    teams = box.groupBy(*_G, "team_code").agg(F.count_if(F.col("is_starter") == 1).alias("starters"))
    per_team = _violations(teams, [*_G, F.col("team_code").alias("subject")], {"five starters": F.col("starters") != 5})
    games = teams.groupBy(*_G).agg(F.count("*").alias("n"))
    per_game = _violations(games, [*_G, F.lit("game").alias("subject")], {"two teams": F.col("n") != 2})
    return per_row.unionByName(per_team).unionByName(per_game)


def play_by_play_violations(pbp: DataFrame) -> DataFrame:
    """Games that break a play-by-play rule; the order check compares with the play count, so no window is needed."""
    clock = F.col("markertime").isNotNull() & (F.trim("markertime") != "")
    g = pbp.groupBy(*_G).agg(
        F.max("period").alias("periods"), F.count_if(~F.col("playtype").isin(C.PLAYTYPES)).alias("unknown"),
        F.count_if(clock).alias("clocks"), F.count_if(clock & F.col("markertime").contains(":")).alias("good_clocks"),
        F.count("*").alias("plays"), F.countDistinct(C.PLAY_ORDER).alias("orders"),
        F.count_if(F.col("playtype") == "IN").alias("ins"), F.count_if(F.col("playtype") == "OUT").alias("outs"),
    )
    return _violations(g, _G, {
        "four periods": F.col("periods") < 4, "known plays": F.col("unknown") > 0,
        "clock format": F.col("good_clocks") <= F.col("clocks") * 0.9, "play order": F.col("plays") != F.col("orders"),
        "substitutions": F.abs(F.col("ins") - F.col("outs")) > 2,
    })


def shot_violations(shots: DataFrame) -> DataFrame:
    return _violations(shots, [*_G, "num_anot"], {
        "x range": ~F.col("coord_x").between(-1000, 1000), "y range": ~F.col("coord_y").between(-200, 1600),
        "points": ~F.col("points").isin(0, 1, 2, 3),
        "action": ~F.col("id_action").isin(C.FIELD_GOAL_PLAYS + C.FREE_THROW_PLAYS),
        "no coordinates": F.col("coord_x").isNull() & F.col("id_action").isin(C.FIELD_GOAL_PLAYS),
    })


def field_profile(df: DataFrame) -> DataFrame:
    """Column, type, row count, NULL count, distinct estimate and a sample of every column: one aggregate."""
    cells = []
    for f in df.schema.fields:
        text = F.col(f.name).cast("string")
        cells.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count("*").alias("rows"),
            F.count_if(F.col(f.name).isNull()).alias("null_rows"), F.min(text).alias("sample"),
        ))
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
