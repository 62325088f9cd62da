"""What stored tables must fulfil before a load may be seen: required values, unique keys, known references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C

_G = C.GAME_KEYS
KEYS = {
    "teams": ["team_code"], "players": ["player_id"], "games": _G, "play_by_play": [*_G, C.PLAY_ORDER], "boxscores": [*_G, "player_id"],
    "player_advanced_stats": [*_G, "player_id"], "shots": [*_G, "num_anot"], "season_on_off_splits": ["season", "player_id", "team"],
}
#: Columns besides the key that must have a value.
REQUIRED = {
    "games": ["home_team", "away_team"], "play_by_play": ["playtype", "period"], "boxscores": ["team_code", "points"], "players": ["team_code"],
    "player_advanced_stats": ["team_code"], "shots": ["team"], "teams": ["team_name"],
}
#: Per table: the table that must know its values, and the columns on both sides.
REFERENCES = {
    "games": [("teams", ["home_team"], ["team_code"]), ("teams", ["away_team"], ["team_code"])],
    "play_by_play": [("games", _G, _G)], "shots": [("games", _G, _G)], "player_advanced_stats": [("games", _G, _G), ("players", ["player_id"], ["player_id"])],
    "boxscores": [("games", _G, _G), ("players", ["player_id"], ["player_id"]), ("teams", ["team_code"], ["team_code"])],
    "season_on_off_splits": [("players", ["player_id"], ["player_id"])],
}
_FOUND = ["table_name", "rule", "violations"]


class ConstraintError(ValueError):
    """A load that breaks constraints; ``found`` lists (table, rule, rows)."""

    def __init__(self, found: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{t}: {r} ({n} rows)" for t, r, n in found))
        self.found = found


def missing_values(name: str, df: DataFrame) -> DataFrame:
    """A row per column that must have a value, in one pass."""
    columns = [*KEYS[name], *REQUIRED.get(name, [])]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.create_map(*[x for c in columns for x in (F.lit(f"{c} is null"), F.col(c))]))
    return counts.select(F.lit(name).alias("table_name"), pairs.alias("rule", "violations"))


def repeated_keys(name: str, df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key; keys with a null part are reported as missing values."""
    whole = df.dropna(subset=KEYS[name]).groupBy(*KEYS[name]).count()
    return whole.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("table_name"), F.lit("key is not unique").alias("rule"), "violations")


def unknown_references(name: str, df: DataFrame, other: str, columns: list[str], known: DataFrame, there: list[str]) -> DataFrame:
    """Rows whose values another table does not have. Rows are counted per value before they meet it, so frequent values do not pile up."""
    used = df.dropna(subset=columns).groupBy(*columns).count()
    known = known.select(*[F.col(t).alias(c) for c, t in zip(columns, there)]).distinct()
    lost = used.join(known.hint("merge"), columns, "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))
    return lost.select(F.lit(name).alias("table_name"), F.lit(f"{', '.join(columns)} not in {other}").alias("rule"), "violations")


def audit(tables: dict[str, DataFrame], known: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, violations``: every rule of every table given, met or not. References are looked up in ``known``."""
    parts = []
    for name, df in tables.items():
        parts += [missing_values(name, df), repeated_keys(name, df)]
        parts += [unknown_references(name, df, other, mine, known[other], there) for other, mine, there in REFERENCES.get(name, [])]
    return reduce(DataFrame.unionByName, [p.select(*_FOUND) for p in parts])
