"""Reading landed files once: what is absent is empty, what cannot be read is put aside, what has been read is remembered.

A load looks up which of the landed files are new, by name, size and time of change, and writes three tables under its number: the
rows, the records that could not be read (with their file and why), and the files themselves. It counts once its number is
claimed, so a load that fails leaves nothing behind that readers see, and of two loads at once one is told to start again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtlake.session import scratch_path
from courtlake.sources import files

RECORD, FILE = "__record", "__file"
_FILES = "file STRING, size LONG, changed TIMESTAMP"
_ASIDE = "file STRING, record STRING, reason STRING"


class Load(NamedTuple):
    number: int  # 0: nothing was new
    n_files: int
    n_rows: int
    n_aside: int


class Landing:
    """The landed files of one feed. ``root`` holds what has been read of it; ``keys`` are columns without which a record is of no use."""

    def __init__(self, spark: SparkSession, root: str, schema: str, fmt: str = "json", keys: tuple[str, ...] = ("Season", "Gamecode"), options: dict[str, str] | None = None):
        if fmt not in ("json", "csv", "parquet", "orc"):
            raise ValueError(f"unknown format: {fmt}")
        self.spark, self.root, self.schema, self.fmt, self.keys, self.options = spark, root, schema, fmt, keys, options or {}

    # -- what has been read -----------------------------------------------------------
    def _loads(self) -> dict[int, str]:
        numbers = [n for n in files.names(self.spark, f"{self.root}/loads") if n.endswith(".json")]
        return {int(n[:-5]): files.read_text(self.spark, f"{self.root}/loads/{n}") for n in numbers}

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = [f"{folder}/{name}" for folder in self._loads().values()]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def rows(self) -> DataFrame:
        return self._table("rows", self.schema)

    def aside(self) -> DataFrame:
        """``file, record, reason`` of what could not be read."""
        return self._table("aside", _ASIDE)

    def ledger(self) -> DataFrame:
        """``file, size, changed, load`` of the files that have been read."""
        return self._table("files", _FILES + ", load INT")

    # -- reading ----------------------------------------------------------------------
    def new_files(self, paths: list[str]) -> DataFrame:
        """Files at the paths (names or patterns; those that do not exist are left out) that no load has read in this state."""
        known = [p for p in paths if files.matches(self.spark, p)]
        if not known:
            return self.spark.createDataFrame([], _FILES)
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(known)
        found = found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")).where("size > 0").distinct()
        return found.join(self.ledger().select("file", "size", "changed"), ["file", "size", "changed"], "left_anti")

    def _read(self, names: list[str]) -> DataFrame:
        """Rows of the files, with the record itself where it does not fit the schema."""
        text = self.fmt in ("json", "csv")
        reader = self.spark.read.schema(self.schema + (f", {RECORD} STRING" if text else "")).format(self.fmt).options(**self.options)
        if text:
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
        else:
            reader = reader.option("ignoreCorruptFiles", "true")
        with _listing(self.spark):
            reader = reader.option("ignoreMissingFiles", "true")
            # All names in one call: a list would be handed over name by name.
            rows = reader._df(reader._jreader.load(self.spark._jvm.org.apache.commons.lang3.StringUtils.split("\0".join(names), "\0")))
            rows = rows.withColumn(FILE, F.col("_metadata.file_path"))
        return rows if text else rows.withColumn(RECORD, F.lit(None).cast("string"))

    def _reason(self) -> Column:
        missing = F.lit(None).cast("string")
        for k in reversed(self.keys):
            missing = F.when(F.col(k).isNull(), f"no {k}").otherwise(missing)
        return F.when(F.col(RECORD).isNotNull(), "unreadable record").otherwise(missing)

    def load(self, paths: list[str]) -> Load:
        """Reads what is new at the paths. Empty files count as absent: they may still be being written."""
        numbers = self._loads()
        number, folder = max(numbers, default=0) + 1, f"{self.root}/parts/{uuid.uuid4().hex}"
        listed = scratch_path(self.spark, "landed")
        with _listing(self.spark):
            self.new_files(paths).write.parquet(listed)
        new = self.spark.read.schema(_FILES).parquet(listed)
        names = [r.file for r in new.select("file").collect()]  # a reader is told its files by name
        if not names:
            return Load(0, 0, 0, 0)
        columns = [c.split()[0] for c in self.schema.split(", ")]
        whole = f"{folder}/all"
        with _listing(self.spark):
            self._read(names).withColumn("__reason", self._reason()).write.parquet(whole)
        rows = self.spark.read.parquet(whole)
        rows.where("__reason IS NULL").select(*columns).write.parquet(f"{folder}/rows")
        record = F.coalesce(F.col(RECORD), F.to_json(F.struct(*columns)))
        aside = rows.where("__reason IS NOT NULL").select(_decoded(FILE).alias("file"), record.alias("record"), F.col("__reason").alias("reason"))
        silent = new.select(_plain(F.col("file")).alias("key"), "file").join(rows.select(_decoded(FILE).alias("key")).distinct(), "key", "left_anti")
        aside.unionByName(silent.select("file", F.lit(None).cast("string").alias("record"), F.lit("unreadable file").alias("reason"))).write.parquet(f"{folder}/aside")
        new.withColumn("load", F.lit(number)).write.parquet(f"{folder}/files")
        files.delete(self.spark, whole)
        if not files.claim(self.spark, f"{self.root}/loads/{number:012d}.json", folder):
            files.delete(self.spark, folder)
            raise RuntimeError(f"load {number} of {self.root} was made by another; load again")
        count = lambda name: self.spark.read.parquet(f"{folder}/{name}").count()
        return Load(number, len(names), count("rows"), count("aside"))


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Files told by name are looked up by a few tasks a core: Spark would start one for each file, up to ten thousand. They are read some hundreds to
    a task: by its default, Spark takes opening a file for as much work as reading 4 MB."""
    keys = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(k) for k in keys]
    cost = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[1])
    for k, v in zip(keys, (min(int(before[0]), 4 * spark.sparkContext.defaultParallelism), min(cost, 1 << 16))):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def _plain(file: Column) -> Column:
    """A file's name with its store's prefix written in one way."""
    return F.regexp_replace(file, r"^([a-z0-9]+):/+", "$1:/")


def _decoded(file: str) -> Column:
    """The name of a row's file as a listing shows it: the metadata column has it with escapes."""
    return _plain(F.url_decode(F.regexp_replace(F.col(file), r"\+", "%2B")))
