"""Bundles: the set of tables one analysis screen needs, built lazily from one parent."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from courtlake import config as C
from courtlake.operators import box as B, clutch as K, lineups as L, playmaking as P, sequences as S
from courtlake.plans.league import League


class Bundle(Mapping):
    """Named tables whose plans are built when first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def game_bundle(pbp: DataFrame, box: DataFrame, shots: DataFrame, totals: DataFrame) -> Bundle:
    """Every per-game table for all games of the given plays, boxscores, shots and segment totals."""
    adv = lambda: B.advanced_stats(box)
    pairs = lambda: P.assist_pairs(pbp)
    return Bundle({
        "advanced_stats": adv,
        "points_created": lambda: B.total_points_created(adv(), pairs()),
        "lineup_stats": lambda: L.lineup_stats(totals),
        "duo_synergy": lambda: L.combo_synergy(totals, 2),
        "trio_synergy": lambda: L.combo_synergy(totals, 3),
        "on_off": lambda: L.on_off_splits(totals, box),
        "run_stoppers": lambda: S.run_stoppers(pbp),
        "foul_trouble": lambda: S.foul_trouble_impact(pbp, box),
        "assist_network": lambda: P.assist_network(pairs()),
        "assist_links": lambda: P.link_assists_to_shots(pairs(), shots),
        "shot_quality": lambda: P.shot_quality(shots, C.GAME_KEYS),
        "positional_scoring": lambda: B.positional_scoring(box),
        "clutch_stats": lambda: K.clutch_stats(K.clutch_plays(pbp), box),
    })


def full_bundle(lg: League) -> Bundle:
    return game_bundle(lg.pbp, lg.box, lg.shots, lg.totals)


def clutch_bundle(lg: League) -> Bundle:
    """The same bundle on clutch time only: lineups come from the whole game, then plays are filtered."""
    plays = K.clutch_plays(lg.tagged)
    pbp = plays.select(*lg.pbp.columns)
    totals = L.segment_totals(plays, lg.segment_lineups)
    return game_bundle(pbp, K.clutch_boxscore(pbp, lg.box), K.clutch_shots(lg.shots), totals)


def team_season_bundle(lg: League, team: str, min_events: int = 20) -> Bundle:
    """Per-game and season tables around one team; its opponents' lineups in those games are included."""
    mine = lg.totals.filter((F.col("team") == team) | (F.col("opponent") == team))
    adv = lg.per_game.filter((F.col("team_code") == team) & (F.col("seconds") > 0))
    return Bundle({
        "per_game_stats": lambda: adv,
        "player_season_stats": lambda: B.season_player_stats(adv, team),
        "lineup_season_stats": lambda: L.lineup_stats(mine, min_events=min_events),
    })
