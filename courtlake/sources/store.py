"""Stored league tables: versions of season partitions behind manifests, checked before they count.

A load writes what it changes into new folders ("staged"), has that checked against the constraints, and then claims the next version by
putting its manifest, which names the folder of every table and season, under that version's number. Only one load can have a number: the other
is told so and starts again from what is stored by then (``transact``). Nothing that may be read is overwritten, and a load that fails leaves the
tables as they were. Only seasons with changes are rewritten, and only the last manifest is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlake import schemas as S
from courtlake.sources import files
from courtlake.sources.constraints import REFERENCES, ConstraintError, audit

SEASONAL = {"games", "play_by_play", "boxscores", "player_advanced_stats", "shots", "season_on_off_splits"}
PARTITIONS_PER_STATEMENT = 500
Entry = tuple[str, int | None, str]
T = TypeVar("T")


class Conflict(RuntimeError):
    """Another load has taken the version since this one read the tables."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.staged: list[Entry] = []
        self.version, self.entries = self._latest()

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def _latest(self) -> tuple[int, dict[tuple[str, int | None], str]]:
        """The last version's folders: an entry per table and season."""
        numbers = [n for n in files.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not numbers:
            return 0, {}
        last = int(numbers[-1][:-5])
        return last, {(n, s): p for n, s, p in json.loads(files.read_text(self.spark, self._manifest(last)))}

    def read(self, name: str, seasons: list[int] | None = None) -> DataFrame:
        """The table as stored and staged, or only some seasons of it: other seasons' folders are not even listed."""
        now = self.entries | {(n, s): p for n, s, p in self.staged}
        return self._frame(name, [p for (n, s), p in sorted(now.items(), key=str) if n == name and (seasons is None or s is None or s in seasons)])

    def _frame(self, name: str, paths: list[str]) -> DataFrame:
        schema = S.struct(name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)

    def stage(self, name: str, df: DataFrame) -> None:
        """Write a new version of the table, or of the seasons that ``df`` holds; it counts once committed."""
        schema, path = S.struct(name), f"{self.root}/{name}/v={uuid.uuid4().hex}"
        have = set(df.columns)
        out = df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        if name not in SEASONAL:
            out.write.parquet(path)
            self.staged.append((name, None, path))
            return
        # A season goes to one task, or to several if it is large: dealt by game, every task would write a file for every season.
        out.hint("rebalance", "season").write.partitionBy("season").parquet(path)
        written = self.spark.read.schema(schema).parquet(path).select("season").distinct().collect()
        self.staged += [(name, r.season, f"{path}/season={'__HIVE_DEFAULT_PARTITION__' if r.season is None else r.season}") for r in written]

    def audit(self, *only: str) -> DataFrame:
        """Every constraint of what is staged, or of some tables of it; references may be met by stored rows as well."""
        names = only or sorted({n for n, _, _ in self.staged})
        staged = {n: self._frame(n, [p for m, _, p in self.staged if m == n]) for n in names}
        return audit(staged, {n: self.read(n) for n in {other for name in names for other, _, _ in REFERENCES.get(name, [])}})

    def commit(self, checked: bool = True) -> int:
        """Switch to what is staged, all of it or nothing. Raises ``ConstraintError`` if it breaks a constraint, ``Conflict`` if another load was
        first; the tables stay as they were then."""
        if checked and self.staged:
            # A table at a time: the driver holds the plan and the seasons' files of one, not of all.
            names = sorted({n for n, _, _ in self.staged})
            found = [tuple(r) for n in names for r in self.audit(n).where("violations > 0").orderBy("rule").collect()]
            if found:
                self.discard()
                raise ConstraintError(found)
        now = self.entries | {(n, s): p for n, s, p in self.staged}
        if not files.claim(self.spark, self._manifest(self.version + 1), json.dumps([(n, s, p) for (n, s), p in now.items()])):
            self.discard()
            raise Conflict(f"version {self.version + 1} is taken")
        self.version, self.entries, self.staged = self.version + 1, now, []
        return self.version

    def discard(self) -> None:
        for name, season, path in self.staged:
            files.delete(self.spark, path if season is None and name not in SEASONAL else path.rsplit("/", 1)[0])
        self.staged = []

    def tidy(self, keep: int = 2) -> None:
        """Removes manifests before the last ``keep`` versions, and folders that only they name; readers of older versions must be done."""
        every = [n for n in files.names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        old, new = every[:-keep], every[-keep:]
        named = lambda ns: {p for n in ns for _, _, p in json.loads(files.read_text(self.spark, f"{self.root}/manifest/{n}"))}
        for path in named(old) - named(new):
            files.delete(self.spark, path)
        for n in old:
            files.delete(self.spark, f"{self.root}/manifest/{n}")


def transact(spark: SparkSession, root: str, build: Callable[[Store], T], attempts: int = 5) -> tuple[Store, T]:
    """``build`` stages a load on the tables as stored; if another load is committed meanwhile it is run again on what that has stored."""
    while True:
        store, attempts = Store(spark, root), attempts - 1
        made = build(store)
        try:
            store.commit()
            return store, made
        except Conflict:
            if not attempts:
                raise


def publish(spark: SparkSession, root: str, database: str = "courtlake") -> int:
    """Catalog tables that show the current version: season tables get a partition per season at the folder that the manifest names, others are
    put at their folder. Tables without rows yet are created empty. Returns the version."""
    store = Store(spark, root)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/catalog'")
    for name in S.TABLES:
        fields = S.struct(name).fields
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        places = {s: p for (n, s), p in store.entries.items() if n == name}
        empty = f"{root}/catalog/{name}"
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        if name in SEASONAL:
            spark.sql(f"CREATE TABLE {database}.{name} ({cols}) USING parquet PARTITIONED BY (season) LOCATION '{empty}'")
            parts = [f"PARTITION (season = {season}) LOCATION '{path}'" for season, path in sorted(places.items())]
            for i in range(0, len(parts), PARTITIONS_PER_STATEMENT):
                spark.sql(f"ALTER TABLE {database}.{name} ADD {' '.join(parts[i : i + PARTITIONS_PER_STATEMENT])}")
        else:
            spark.sql(f"CREATE TABLE {database}.{name} ({cols}) USING parquet LOCATION '{places.get(None, empty)}'")
    return store.version
