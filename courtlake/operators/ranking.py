"""Leaderboards and top-N tables.

``row_number() <= n`` lets Spark keep only n rows per task and group before the
shuffle, so a huge group is cut down on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BOARDS = {
    "points": None, "rebounds": None, "assists": None, "turnovers": None,
    "fg2_pct": "q_fg2", "fg3_pct": "q_fg3", "ft_pct": "q_ft",
}


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def leaderboards(qualified: DataFrame, n: int = 10) -> DataFrame:
    """Seven boards (four volume, three percentage) in one pass."""
    entry = [
        F.struct(F.lit(b).alias("board"), F.col(b).cast("double").alias("value"),
                 (F.col(q) if q else F.lit(True)).alias("ok"))
        for b, q in BOARDS.items()
    ]
    long = qualified.select(
        "season", "player_code", "player_name", "team_code", F.explode(F.array(*entry)).alias("e")
    ).filter("e.ok").select("season", "player_code", "player_name", "team_code", "e.board", "e.value")
    return top_n(long, ["season", "board"], [F.desc("value"), F.col("player_code"), F.col("team_code")], n)


def best_and_worst(df: DataFrame, keys: list[str], measure: str, ties: list[str], best: int, worst: int) -> DataFrame:
    """First ``best`` and last ``worst`` rows per group by a measure."""
    up = top_n(df, keys, [F.desc(measure), *map(F.col, ties)], best).withColumn("end", F.lit("best"))
    down = top_n(df, keys, [F.asc(measure), *map(F.col, ties)], worst).withColumn("end", F.lit("worst"))
    return up.unionByName(down)


def order_table(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def last_games(adv: DataFrame, n: int = 5) -> DataFrame:
    return top_n(adv.filter(F.col("seconds") > 0), ["season", "player_id"], [F.desc("gamecode")], n, "games_ago")


def concat_frames(*frames: DataFrame) -> DataFrame:
    """Row-wise concat that tolerates optional columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
