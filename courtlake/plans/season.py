"""The season ETL: load the games that are missing, merge them into the stored tables, rebuild the aggregates they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlake import config as C
from courtlake.operators import box as B, lineups as L
from courtlake.session import scratch_path
from courtlake.sources import feeds as S, files, sinks as W
from courtlake.sources.store import Store, transact

_G = C.GAME_KEYS


def sync_games(
    spark: SparkSession, root: str, box: DataFrame, pbp: DataFrame, shots: DataFrame, schedule: DataFrame,
    metadata: DataFrame, teams: DataFrame, players: DataFrame | None = None,
) -> DataFrame:
    """Load the played games that ``root`` lacks; report total, loaded and failed games per season.

    A game is loaded when the feeds hold its boxscore and its plays, else it has failed and is tried again by the
    next sync. Stored rows of other games, seasons, teams and players stay. All tables switch together at the end, if they meet the
    constraints; if another load has been committed meanwhile, this one is made again on top of it.
    """

    def build(store: Store) -> DataFrame:
        missing = S.missing_games(schedule, store.read("boxscores"))
        path = scratch_path(spark, "missing-games")
        missing.join(box.select(*_G), _G, "left_semi").join(pbp.select(*_G), _G, "left_semi").write.parquet(path)
        new = spark.read.schema("season INT, gamecode INT").parquet(path)
        fresh = lambda df: df.join(new, _G, "left_semi")
        seasons = sorted(r.season for r in new.select("season").distinct().collect())

        merged = lambda df: df.drop("change")
        scheduled = sorted(r.season for r in schedule.select("season").distinct().collect())
        games = merged(W.seed_schedule(store.read("games", scheduled), schedule))
        games = merged(W.load_games(games, S.game_info(fresh(box), fresh(pbp))))
        store.stage("games", merged(W.patch_referees(games, metadata)))
        clubs = merged(W.load_teams_from_schedule(store.read("teams"), teams))
        store.stage("teams", merged(W.load_teams(clubs, fresh(box))))
        people = merged(W.load_players(store.read("players"), fresh(box)))
        if players is not None:
            people = merged(W.merge(people, players.select("player_id", "height", "birthdate", "position", "country"), ["player_id"], insert=False))
        store.stage("players", people)
        if seasons:
            for name, feed in (("boxscores", box), ("play_by_play", pbp), ("shots", shots)):
                store.stage(name, W.replace_games(store.read(name, seasons), fresh(feed)))
            adv = W.load_advanced_stats(store.read("player_advanced_stats", seasons), B.advanced_stats(fresh(store.read("boxscores", seasons))))
            store.stage("player_advanced_stats", merged(adv))
            aggregate_seasons(store, seasons)
        return new

    store, new = transact(spark, root, build)
    done = new.withColumn("ok", F.lit(True))
    known = store.read("boxscores").select(*_G).distinct().withColumn("stored", F.lit(True))
    report = schedule.filter("played").select(*_G).join(done.hint("merge"), _G, "left").join(known.hint("merge"), _G, "left")
    return report.groupBy("season").agg(F.count("*").alias("total"), F.count("ok").alias("loaded"), F.count_if(F.col("stored").isNull()).alias("failed"))


def aggregate_seasons(store: Store, seasons: list[int]) -> None:
    """Season on/off splits of the given seasons, from their stored plays and boxscores; other seasons are not read.

    Plays with their segments and the segment totals are each read by several branches: written in between, their plans are not repeated in
    each branch, which would make one of hundreds of exchanges that the driver holds in every state.
    """
    box, pbp = store.read("boxscores", seasons), store.read("play_by_play", seasons)
    tagged, at = _written(L.tag_segments(pbp, box), "tagged")
    totals, totals_at = _written(L.segment_totals(tagged, L.segment_lineups(tagged, box)), "totals")
    store.stage("season_on_off_splits", L.season_on_off(L.on_off_splits(totals, box)))
    for path in (at, totals_at):
        files.delete(store.spark, path)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path

