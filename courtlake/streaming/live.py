"""Live games: play-by-play files landing while a game is on.

The source has no change feed; files may repeat plays, and plays may come late and out of order.
Nothing is dropped for being late and no state is kept in the stream: each micro-batch is compared with
the plays already stored of the games it touches, which a ``GameLog`` finds by season and game bucket. Player
statistics are not recomputed: a micro-batch's counts are added to the stored ones. Every write is keyed by micro-batch, so a
restarted query replaces its own output.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from courtlake import config as C, schemas as S
from courtlake.operators import box as B, lineups as L, live_box as P, sequences as Q
from courtlake.sources import files
from courtlake.sources.clean import clean_play_by_play
from courtlake.streaming.log import GameLog, bucket_bits, bucket_of, last_batches, of_batches, unsigned

_G = C.GAME_KEYS
PLAY_KEY = ["season", "gamecode", C.PLAY_ORDER]
TABLES = ("scores", "current_lineups", "active_run", "run_history", "momentum", "win_probability", "players")


def play_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Cleaned plays of a landing folder as they arrive, repeats included."""
    reader = spark.readStream.schema(S.RAW_PLAY_BY_PLAY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return clean_play_by_play(reader.parquet(landing))


def play_log(spark: SparkSession, out: str) -> GameLog:
    return GameLog(spark, f"{out}/plays", S.struct("play_by_play"), [C.PLAY_ORDER])


def game_log(spark: SparkSession, out: str) -> GameLog:
    """The games that each micro-batch brought plays of."""
    return GameLog(spark, f"{out}/games", StructType.fromDDL("season INT, gamecode INT"))


def count_log(spark: SparkSession, out: str) -> GameLog:
    return GameLog(spark, f"{out}/counts", StructType.fromDDL(P.COUNTS))


def stored_plays(spark: SparkSession, out: str) -> DataFrame:
    """Every play stored so far, once."""
    return play_log(spark, out).read()


def not_stored(plays: DataFrame, stored: DataFrame) -> DataFrame:
    """The plays that the log doesn't hold yet. Its keys take little room in files but many times that in memory, so they are shuffled,
    not sent through the driver."""
    return plays.join(stored.select(*PLAY_KEY).hint("merge"), PLAY_KEY, "left_anti")


def current_lineups(plays: DataFrame, box: DataFrame) -> DataFrame:
    tagged = L.tag_segments(plays, box)
    return L.current_lineups(L.segment_totals(tagged, L.segment_lineups(tagged, box)))


def live_table(name: str, plays: DataFrame, box: DataFrame) -> DataFrame:
    """A table of the given games' plays; the boxscores only say who plays for whom and who starts."""
    made = {
        "scores": Q.live_score, "active_run": Q.active_run, "run_history": Q.run_stoppers, "momentum": Q.momentum_timeline,
        "win_probability": Q.win_probability_timeline,
    }
    return current_lineups(plays, box) if name == "current_lineups" else made[name](plays)


def live_players(counts: DataFrame) -> DataFrame:
    """Player table of the plays counted so far: those who have been on court."""
    cols = [*_G, "player_id", "player_name", "team_code", "minutes", "points", "total_rebounds", "assists", "ts_pct", "off_rating", "def_rating"]
    return B.advanced_stats(P.live_boxscore(counts)).filter(F.col("seconds") > 0).select(*cols)


def write_live_games(
    plays: DataFrame, box: DataFrame, out: str, checkpoint: str, tables: tuple[str, ...] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Per micro-batch: append the plays that are new, then recompute the games they touch, and only those.

    ``out/plays`` is the log of plays, ``out/<table>`` a log of each table in which a game's rows of its last micro-batch count.
    ``trigger`` is that of ``DataStreamWriter.trigger``; by default what has landed is processed and the query ends.
    """
    wanted = tables or TABLES

    def handle(batch: DataFrame, n: int) -> None:
        spark, work = batch.sparkSession, f"{out}/work/{n}-{uuid.uuid4().hex}"

        def written(name: str, df: DataFrame) -> DataFrame:
            """Kept as files and not in the cache, where it would stay in as many partitions as a shuffle has, however few rows there are."""
            df.write.parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        new = written("new", batch.dropDuplicates(PLAY_KEY).withColumn("bucket", bucket_of()))
        held = new.groupBy("season").agg(bucket_bits().alias("bits"), F.count("*").alias("n")).collect()
        places, most = unsigned((r.season, r.bits) for r in held), sum(r.n for r in held)
        if places:
            update(spark, n, new, places, most, written)
        files.delete(spark, work)

    def update(spark: SparkSession, n: int, new: DataFrame, places: dict[int, int], most: int, written: Callable[[str, DataFrame], DataFrame]) -> None:
        log = play_log(spark, out)
        fresh = written("fresh", not_stored(new, log.read(places, n)))
        log.append(n, fresh, most, places)
        games = game_log(spark, out)
        games.append(n, fresh.select(*_G).distinct(), most, places, last_batches)
        current = last_batches(games.read(before=n + 1))
        touched = written("touched", current.where(F.col("batch") == n).select(*_G))
        mine = written("mine", log.read(places, n + 1).drop("batch", "bucket").join(touched, _G, "left_semi"))
        keep = lambda rows: of_batches(rows, current)

        def players() -> DataFrame:
            counts = count_log(spark, out)
            known = of_batches(counts.read(places, n), last_batches(games.read(places, n))).join(touched, _G, "left_semi")
            now = P.add_counts(known, P.play_counts(fresh)) if n else P.play_counts(fresh)
            counts.append(n, now, most, places, keep)
            return live_players(counts.read(places, n + 1).where(F.col("batch") == n))

        def write(name: str) -> None:
            table = players() if name == "players" else live_table(name, mine, box.join(touched, _G, "left_semi"))
            GameLog(spark, f"{out}/{name}", table.schema).append(n, table, most, places, keep)
            if not files.exists(spark, f"{out}/{name}/schema.json"):
                files.write_text(spark, f"{out}/{name}/schema.json", table.schema.json())

        with ThreadPoolExecutor(len(wanted)) as pool:  # the tables do not depend on each other
            list(pool.map(write, wanted))

    return (
        plays.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start()
    )


def latest_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """Rows of each game from the last micro-batch that brought plays of it."""
    log = GameLog(spark, f"{out}/{name}", StructType.fromJson(json.loads(files.read_text(spark, f"{out}/{name}/schema.json"))))
    return of_batches(log.read(), last_batches(game_log(spark, out).read())).select(*[f.name for f in log.columns])
