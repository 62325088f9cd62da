"""Connected components over an edge table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlake.session import scratch_path


_OPEN: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes within are removed at the end; what is to outlive them is written by other means."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_PATHS: dict[int, str] = {}


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(id(df), None):
            _delete(df.sparkSession, path)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps re-read files, not the plan.

    At most ``files`` tasks write it, a file each: on a local file system an executor starts a few short processes per file, and until one runs its
    own program it has all the memory of its executor, which a sum over processes counts again.

    Since nothing else reads this plan's shuffles, their files go as soon as the table is written, not when the driver's JVM happens to collect
    their handles.
    """
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    spark, before = df.sparkSession, df.sparkSession.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.coalesce(files) if files else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of an edge, where root is the smallest node reachable; any ordered node type.

    Edges with a null end and loops link nothing. Each step keeps every component connected and moves
    edges towards its smallest node; it ends when a step changes nothing. Minima are combined before the
    shuffle and joined back, so a node with many edges is never gathered in one place.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    e, last = stored(e, "edges", files), None
    while True:
        both = e.unionAll(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = e.select(F.col("u").alias("v"), F.col("v").alias("x")).join(least, "v").select(F.col("x").alias("v"), F.col("m").alias("u"))
        large = stored(large.where("u < v").distinct(), "edges", files)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("v", "u", "m")
        small = small.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*")
        small = stored(small.where("u < v").distinct(), "edges", files)
        drop_stored(e, large)
        e, before, last = small, last, _digest(small)
        if last == before or last[0] == 0:
            break
    star = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return star.unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    h = F.xxhash64("v", "u")
    return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum((h.bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0))).first())
