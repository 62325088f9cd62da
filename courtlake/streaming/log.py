"""A log of rows per game, appended by micro-batches and merged as it grows.

Each micro-batch appends one *segment*: rows sorted by season, game bucket and game, in as few files as its rows need.
As soon as ``FAN`` segments of one level are there they are merged into one of the next, so a row is rewritten once a
level and the log has less than ``FAN`` segments a level, however many micro-batches there were. A manifest per micro-batch
lists the segments with an index of their files: which seasons and buckets a file may hold, a number of ``GAME_BUCKETS`` bits
per season. Readers that want some games open the files of their buckets only. A micro-batch that is run again starts from the manifest before
it and replaces its own; what the last two manifests name is kept, anything older is removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from courtlake.sources import files

FAN = 4
GAME_BUCKETS = 64
FILE_ROWS = 1_000_000
SMALL_ROWS = 20_000  # so few rows are not worth a shuffle of their own
Place = tuple[int, int]  # season, bucket
Places = set[Place] | dict[int, int]  # or per season a bit for each bucket


def bucket_of(gamecode: str = "gamecode"):
    return F.expr(f"CAST(pmod({gamecode}, {GAME_BUCKETS}) AS INT)")


def bits_of(places: Places) -> dict[int, int]:
    """Per season the buckets, a bit each."""
    if isinstance(places, dict):
        return places
    out: dict[int, int] = {}
    for season, bucket in places:
        out[season] = out.get(season, 0) | 1 << bucket
    return out


def bucket_bits(bucket: str = "bucket"):
    """Aggregate: the buckets there are, a bit each (of a signed long)."""
    return F.expr(f"bit_or(shiftleft(1L, {bucket}))")


def unsigned(rows) -> dict[int, int]:
    return {season: bits % (1 << GAME_BUCKETS) for season, bits in rows if season is not None and bits is not None}


class GameLog:
    """Rows with ``season`` and ``gamecode``; the log adds ``batch``, the micro-batch that brought a row."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, order: list[str] | None = None):
        self.spark, self.root = spark, root
        self.columns = [f for f in schema.fields if f.name not in ("batch", "bucket")]
        self.schema = StructType([*self.columns]).add("batch", LongType()).add("bucket", IntegerType())
        self.order = ["season", "bucket", "gamecode", *(order or [])]

    # -- manifests ----------------------------------------------------------------
    def _manifest(self, n: int) -> str:
        return f"{self.root}/manifest/{n:012d}.json"

    def _numbers(self) -> list[int]:
        return [int(x[:12]) for x in files.names(self.spark, f"{self.root}/manifest") if x.endswith(".json")]

    def _segments(self, before: int | None = None) -> list[dict]:
        numbers = [n for n in self._numbers() if before is None or n < before]
        return json.loads(files.read_text(self.spark, self._manifest(numbers[-1]))) if numbers else []

    def segments(self, before: int | None = None) -> list[dict]:
        """The segments after the last micro-batch, or after the last one before a number; ``files`` lists file, season and bucket."""
        each = lambda s: [(f, season, b) for f, held in s["files"] for season, bits in held for b in range(GAME_BUCKETS) if bits >> b & 1]
        return [s | {"files": each(s)} for s in self._segments(before)]

    # -- reading ------------------------------------------------------------------
    def read(self, places: Places | None = None, before: int | None = None) -> DataFrame:
        """All rows, or those of some (season, bucket): only files that hold rows of these are opened."""
        return self._rows(self._segments(before), places)

    def _rows(self, segments: list[dict], places: Places | None = None) -> DataFrame:
        index = {f: held for s in segments for f, held in s["files"]}
        bits = {} if places is None else bits_of(places)
        if places is not None:
            index = {f: held for f, held in index.items() if any(b & bits.get(season, 0) for season, b in held)}
        if not index:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*sorted(index))
        if places is None or not any(b & ~bits.get(season, 0) for held in index.values() for season, b in held):
            return rows
        return rows.join(self._frame(bits), ["season", "bucket"], "left_semi").select(*self.schema.names)

    def _frame(self, bits: dict[int, int]) -> DataFrame:
        """(season, bucket) rows: a filter that names every one of them would grow with the seasons."""
        text = json.dumps([{"season": s, "bits": b - (b >> GAME_BUCKETS - 1 << GAME_BUCKETS)} for s, b in sorted(bits.items())])
        seasons = self.spark.range(1).select(F.inline(F.from_json(F.lit(text), "ARRAY<STRUCT<season: INT, bits: BIGINT>>")))
        return seasons.select("season", "bits", F.explode(F.sequence(F.lit(0), F.lit(GAME_BUCKETS - 1))).alias("bucket")).where("getbit(bits, bucket) = 1").drop("bits")

    # -- writing ------------------------------------------------------------------
    def _write(self, rows: DataFrame, n_rows: int, level: int, bits: dict[int, int]) -> dict:
        """One file holds all places given; of several, a look at them tells which holds which."""
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        parts = max(1, -(-n_rows // FILE_ROWS))
        dealt = rows.coalesce(1) if n_rows <= SMALL_ROWS else rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, *self.order)
        dealt.sortWithinPartitions(*self.order).write.parquet(path)
        if parts == 1:
            held = {f"{path}/{f}": bits for f in files.names(self.spark, path) if f.endswith(".parquet")}
        else:
            file = F.col("_metadata.file_path").alias("file")
            found: dict[str, list] = {}
            for f, season, b in self.spark.read.schema(self.schema).parquet(path).groupBy(file, "season").agg(bucket_bits()).collect():
                found.setdefault(f, []).append((season, b))
            held = {f: unsigned(pairs) for f, pairs in found.items()}
        return {"path": path, "level": level, "rows": n_rows, "files": [[f, sorted(b.items())] for f, b in sorted(held.items())]}

    def append(self, n: int, rows: DataFrame, n_rows: int, places: Places, combine: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
        """Adds the rows as micro-batch ``n``. ``n_rows`` is about their number, ``places`` holds every (season, bucket) they may lie in.
        Merged rows go through ``combine``, which may drop those that no longer count."""
        rows = rows.drop("batch", "bucket").withColumns({"batch": F.lit(n).cast("long"), "bucket": bucket_of()})
        segments = [*self._segments(n), self._write(rows, n_rows, 0, bits_of(places))]
        level = 0
        while len(same := [s for s in segments if s["level"] == level]) >= FAN:
            merged = self._rows(same)
            if combine:
                merged = combine(merged)
            held: dict[int, int] = {}
            for season, b in (x for s in same for _, pairs in s["files"] for x in pairs):
                held[season] = held.get(season, 0) | b
            segments = [s for s in segments if s["level"] != level] + [self._write(merged, sum(s["rows"] for s in same), level + 1, held)]
            level += 1
        files.write_text(self.spark, self._manifest(n), json.dumps(segments))  # two numbers a season and file, not a line per place
        self._tidy(n)
        return segments

    def _tidy(self, n: int) -> None:
        """Removes segments that only manifests before the last two name, and those manifests."""
        numbers = [k for k in self._numbers() if k <= n]
        named = lambda ks: {s["path"] for k in ks for s in json.loads(files.read_text(self.spark, self._manifest(k)))}
        for path in named(numbers[:-2]) - named(numbers[-2:]):
            files.delete(self.spark, path)
        for k in numbers[:-2]:
            files.delete(self.spark, self._manifest(k))


def last_batches(log: DataFrame) -> DataFrame:
    """(season, gamecode, batch, bucket) of each game's last micro-batch."""
    return log.groupBy("season", "gamecode").agg(F.max("batch").alias("batch")).withColumn("bucket", bucket_of())


def of_batches(rows: DataFrame, current: DataFrame) -> DataFrame:
    """The rows that the given micro-batch of their game brought."""
    return rows.join(current.select("season", "gamecode", "batch"), ["season", "gamecode", "batch"], "left_semi")
