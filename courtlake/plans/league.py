"""The league's tables as lazily built DataFrames, shared by the registered queries and the bundles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from courtlake.functions.exprs import team_alias
from courtlake.operators import box as B, lineups as L, league as T, models as M, playmaking as P
from courtlake.session import scratch_path
from courtlake.sources import adapter as A, clean as N, feeds as S, files


# Tables already written in this application: (application, state of the data, table) -> (path, schema).
_WRITTEN: dict[tuple, tuple[str, StructType]] = {}


class League:
    """The league over all seasons of a data folder.

    The cleaned feeds are loaded once per application into parquet tables in the
    shared folder, as the season ETL does; a lost executor re-reads files. All
    statistics are computed from these tables by every query that asks for them.
    Plays with their segment numbers, the segment totals and the assist pairs
    feed several consumers and are persisted; ``release`` drops them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: list[DataFrame] = []

    def state(self, *tables: str) -> tuple:
        """What tells one state of the given tables from another: their files, sizes and times of change."""
        return (self.sf_dir, *(x for t in tables for x in files.state(self.spark, f"{self.sf_dir}/{t}.parquet")))

    def raw(self, feed: str) -> DataFrame:
        return getattr(A, f"raw_{feed}")(self.spark, self.sf_dir)

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.state("events"), name)
        if key not in _WRITTEN:
            df, path = build(), scratch_path(self.spark, name)
            df.write.parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()

    @cached_property
    def box(self) -> DataFrame:
        return self._table("boxscores", lambda: N.clean_boxscores(self.raw("boxscore")))

    @cached_property
    def pbp(self) -> DataFrame:
        return self._table("play_by_play", lambda: N.clean_play_by_play(self.raw("play_by_play")))

    @cached_property
    def shots(self) -> DataFrame:
        return self._table("shots", lambda: N.clean_shots(self.raw("shots")))

    @cached_property
    def schedule(self) -> DataFrame:
        return self._table("schedule", lambda: N.clean_schedule(self.raw("schedule")))

    @cached_property
    def metadata(self) -> DataFrame:
        return self._table("metadata", lambda: S.game_metadata(self.raw("game_metadata")))

    @cached_property
    def extra(self) -> DataFrame:
        return self._table("extra_rounds", lambda: S.extra_rounds(self.raw("extra_rounds")))

    @cached_property
    def logos(self) -> DataFrame:
        return S.club_logos(self.raw("extra_rounds"))

    @cached_property
    def games(self) -> DataFrame:
        return S.games_table(self.schedule, self.metadata)

    @cached_property
    def fixtures(self) -> DataFrame:
        """Played games plus every return fixture as still to play."""
        future = self.extra.select(
            "season", "gamecode", F.col("home_code").alias("home_team"), F.col("away_code").alias("away_team"),
            F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"),
            F.col("date").alias("game_date"), "game_day", "round", F.lit(False).alias("played"),
        )
        return S.games_table(self.schedule).unionByName(future)

    @cached_property
    def teams(self) -> DataFrame:
        return self._table("teams", lambda: S.teams_table(self.schedule, self.logos))

    @cached_property
    def players(self) -> DataFrame:
        return self._table("players", lambda: self.raw("players").withColumn("team_code", team_alias("team_code")))

    @cached_property
    def adv(self) -> DataFrame:
        return B.advanced_stats(self.box)

    @cached_property
    def efficiency(self) -> DataFrame:
        return T.efficiency_landscape(self.adv, self.games, self.teams)

    @cached_property
    def tagged(self) -> DataFrame:
        return self._keep(L.tag_segments(self.pbp, self.box))

    @cached_property
    def segment_lineups(self) -> DataFrame:
        return L.segment_lineups(self.tagged, self.box)

    @cached_property
    def totals(self) -> DataFrame:
        return self._keep(L.segment_totals(self.tagged, self.segment_lineups))

    @cached_property
    def player_features(self) -> DataFrame:
        return self._keep(M.player_season_features(self.adv))

    @cached_property
    def lineup_features(self) -> DataFrame:
        return self._keep(M.lineup_features(L.lineup_stats(self.totals), self.player_features, ["season", "team", "lineup"]))

    @cached_property
    def on_off(self) -> DataFrame:
        return L.on_off_splits(self.totals, self.box)

    @cached_property
    def season_on_off(self) -> DataFrame:
        return L.season_on_off(self.on_off)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(P.assist_pairs(self.pbp))

    @cached_property
    def links(self) -> DataFrame:
        return P.link_assists_to_shots(self.pairs, self.shots)

    @cached_property
    def per_game(self) -> DataFrame:
        """Advanced stats with points created."""
        return B.total_points_created(self.adv, self.pairs)
