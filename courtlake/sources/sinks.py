"""Keyed merges.

``merge`` is the one upsert: a full outer join on the key with a rule per
column. The loaders are configurations of it; ``store`` keeps their results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from courtlake import config as C

_G = C.GAME_KEYS
Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_known(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def ever_true(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def merge(
    stored: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None,
    default: Rule = keep_known, insert: bool = True,
) -> DataFrame:
    """Stored rows with ``updates`` applied.

    Of several updates of one key one is taken. ``rules`` decides a column of a row found
    on both sides; columns the updates lack stay as stored. ``insert=False``
    ignores unknown keys. ``change`` says inserted, updated or kept.
    """
    rules = rules or {}
    old = stored.withColumn("__in_old", F.lit(True))
    new = updates.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"__n_{c}") for c in updates.columns if c not in keys]).withColumn(
        "__in_new", F.lit(True)
    )
    # Files may be many times smaller than their rows: updates are not to be gathered in the driver for a broadcast.
    df = old.join(new.hint("merge"), keys, "full_outer" if insert else "left")
    in_old, in_new = F.col("__in_old").isNotNull(), F.col("__in_new").isNotNull()
    cols = []
    for c in stored.columns:
        if c in keys or f"__n_{c}" not in df.columns:
            cols.append(F.col(c))
            continue
        rule = rules.get(c, default)
        o, n = F.col(c), F.col(f"__n_{c}")
        cols.append(F.when(in_old & in_new, rule(o, n)).when(in_new, n).otherwise(o).alias(c))
    change = F.when(in_old & in_new, "updated").when(in_new, "inserted").otherwise("kept").alias("change")
    return df.select(*cols, change)


def merge_counts(merged: DataFrame) -> DataFrame:
    changed = F.count_if(F.col("change") != "kept")
    return merged.agg(
        changed.alias("total"), F.count_if(F.col("change") == "inserted").alias("inserted"),
        F.count_if(F.col("change") == "updated").alias("updated"),
    )


def replace_games(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Delete and insert per game: every game in ``fresh`` loses its stored rows first."""
    kept = stored.join(fresh.select(*_G).distinct(), _G, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


# -- loaders ------------------------------------------------------------------
def load_teams(stored: DataFrame, box: DataFrame) -> DataFrame:
    """Teams seen in boxscores; a real name already stored is kept over the code."""
    seen = box.select("team_code").distinct().withColumn("team_name", F.col("team_code"))
    name = lambda o, n: F.when(F.col("team_code") == o, n).otherwise(o)
    return merge(stored, seen, ["team_code"], {"team_name": name})


def load_teams_from_schedule(stored: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams of the schedule; a name equal to the code never replaces a stored name."""
    name = lambda o, n: F.coalesce(F.nullif(n, F.col("team_code")), o)
    return merge(stored, teams, ["team_code"], {"team_name": name})


def update_teams_metadata(stored: DataFrame, teams: DataFrame) -> DataFrame:
    return merge(stored, teams, ["team_code"], insert=False)


def players_of(box: DataFrame) -> DataFrame:
    """One row per player: the first boxscore row of the batch."""
    first = F.min(F.struct("season", "gamecode", "team_code", "player_name", "dorsal"))
    return box.groupBy("player_id").agg(first.alias("r")).select("player_id", "r.player_name", "r.team_code", "r.dorsal")


def load_players(stored: DataFrame, box: DataFrame) -> DataFrame:
    return merge(stored, players_of(box), ["player_id"], default=take_new)


def load_games(stored: DataFrame, info: DataFrame) -> DataFrame:
    return merge(stored, info, _G)


def seed_schedule(stored: DataFrame, schedule: DataFrame) -> DataFrame:
    """Fixtures into ``games``: known scores stay, ``played`` only ever turns true."""
    rows = schedule.select(
        *_G, F.col("home_code").alias("home_team"), F.col("away_code").alias("away_team"), "home_score", "away_score",
        F.col("date").alias("game_date"), "game_day", "round", "played",
    )
    return merge(stored, rows, _G, {"home_team": take_new, "away_team": take_new, "played": ever_true})


def patch_games(stored: DataFrame, schedule: DataFrame) -> DataFrame:
    rows = schedule.filter("played").select(*_G, "round", F.col("date").alias("game_date"), "game_day", "played")
    return merge(stored, rows, _G, {"played": ever_true}, insert=False)


def patch_referees(stored: DataFrame, metadata: DataFrame) -> DataFrame:
    refs = metadata.select(*_G, "referee1", "referee2", "referee3").filter(
        F.col("referee1").isNotNull() | F.col("referee2").isNotNull() | F.col("referee3").isNotNull()
    )
    return merge(stored, refs, _G, insert=False)


def load_advanced_stats(stored: DataFrame, adv: DataFrame) -> DataFrame:
    return merge(stored, adv, [*_G, "player_id"], default=take_new)


def load_on_off(stored: DataFrame, on_off: DataFrame) -> DataFrame:
    return merge(stored, on_off, ["season", "player_id", "team"], default=take_new)
