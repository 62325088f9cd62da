"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes each document floor(r) times, and once more with
probability r - floor(r). The cube method rounds these probabilities: in every step three undecided
documents move along the null space of the constraints (documents and words taken) until one of them
reaches 0 or 1, so both totals stay exactly as they are. Documents of a source are dealt into buckets of
a bounded size; the two or fewer that a bucket leaves undecided meet those of other buckets in the next
level. Before the last ones land, the constraint on documents is given up: pairs move along that on
words alone, against some short documents kept back for this. The landing decides the one that is left
and turns over a few documents (four times one or two at most) so that the words come nearest to the target.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlake.llm.components import stored

_EPS = 1e-9
MOST_COPIES = 3


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``key, source_size, target`` per source: shares by weight, capped at ``MOST_COPIES`` times the size, the excess reshared.

    Weights follow the order of the source names; it is counted range by range, not in one task.
    """
    spark = sized.sparkSession
    total = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranged = stored(total.repartitionByRange(F.col(source).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, n = {}, 0
    for part, k in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # one number per partition
        before[part], n = n, n + k
    offset = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col(source).asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = ranged.join(offset, "part").select(key_of(source).alias("key"), "source_size", "docs", weight.alias("weight"))
    s = stored(s, "sources")
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, cap = 0.0, F.col("source_size") * float(MOST_COPIES)
    while True:  # a source is capped once the level passes its cap; the level only rises, so this ends
        full = F.col("weight") * level >= cap
        capped, free = s.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (whole - capped) / free if free else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return s.select("key", "source_size", "docs", F.when(F.col("weight") * level >= cap, cap).otherwise(F.col("weight") * level).alias("target"))


def key_of(source: str):
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def flight(p: list[float], size: list[float], draws: np.ndarray) -> None:
    """Moves ``p`` in place, three undecided at a time, until two or fewer are left between 0 and 1."""
    active: list[int] = []
    draw = iter(draws.tolist())
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(active, u) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(active, u) if v)
            step = up if next(draw) * (up + down) < down else -down
            for k, v in zip(active, u):
                x = p[k] + step * v
                p[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            active = [k for k in active if 0.0 < p[k] < 1.0]


def pair_flight(p: list[float], size: list[float], order: list[int], draws: np.ndarray) -> None:
    """The same with the constraint on words alone, two at a time in the order given, until one is left."""
    draw, a = iter(draws.tolist()), None
    for b in order:
        if not _EPS < p[b] < 1 - _EPS:
            continue
        if a is None:
            a = b
            continue
        u = (max(size[b], 1.0), -max(size[a], 1.0))
        up = min((1 - p[a]) / u[0], p[b] / -u[1])
        down = min(p[a] / u[0], (1 - p[b]) / -u[1])
        step = up if next(draw) * (up + down) < down else -down
        for k, v in ((a, u[0]), (b, u[1])):
            x = p[k] + step * v
            p[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        a = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else None


def landing(p: list[float], size: list[float], due: float, most_flips: int = 4) -> None:
    """Decides the last ones so that the words taken come nearest to ``due``: all ways to round what is undecided
    (two or fewer), then, while that brings the words nearer, one or two decided documents turn over."""
    left = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    taken = sum(s for x, s in zip(p, size) if x == 1.0)
    best = min(itertools.product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(taken + sum(x * size[i] for x, i in zip(c, left)) - due), c))
    for i, x in zip(left, best):
        p[i] = x
    for _ in range(most_flips):
        off = sum(s for x, s in zip(p, size) if x == 1.0) - due
        change = sorted((size[i] if p[i] == 0.0 else -size[i], i) for i in range(len(p)))
        values = [c for c, _ in change]
        found = (abs(off), ())
        for c, i in change:
            found = min(found, (abs(off + c), (i,)))
            at = bisect.bisect_left(values, -off - c)
            for d, j in change[max(at - 1, 0) : at + 1]:
                if j != i:
                    found = min(found, (abs(off + c + d), (i, j)))
        if not found[1] or found[0] > abs(off) - 1:
            break
        for i in found[1]:
            p[i] = 1.0 - p[i]


def copies_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), bucket_docs: int = 5000) -> DataFrame:
    """``id, __hash`` (of id and text), ``size`` (words), ``source_size, target, copies`` and ``taken`` = copies * size per row.

    Null and empty texts have size 0. A null source is a source of its own, the last. A source without words
    has target 0 and takes nothing. Rows of one id count each on its own. Other columns are ignored; an empty
    table gives an empty one. Reruns agree: draws come from hashes.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(source).alias("__source"), size_of(text).alias("size"), F.xxhash64(id_col, text).alias("__hash"))
    slim = stored(slim, "sizes")
    targets = source_targets(slim, "__source", weights)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    units = slim.withColumn("key", key_of("__source")).join(targets, "key").withColumn("whole", F.floor(rate + _EPS).cast("long"))
    units = units.withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    kept_back = (4 * F.col("size") * F.col("docs") < F.col("source_size")) & (F.pmod(F.xxhash64("__hash", "__id"), F.col("docs")) < F.lit(bucket_docs // 10))
    units = units.withColumn("short", kept_back)
    names = ["__id", "__hash", "key", "size", "source_size", "target", "whole", "p", "short", "docs"]
    units = units.select(*names)
    schema = units.schema

    def fly(last: bool):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("__hash", "ascending"), ("__id", "ascending")]))
            p, size = rows.column("p").to_pylist(), [float(s) for s in rows.column("size").to_pylist()]
            rng = np.random.default_rng([len(p), rows.column("__hash")[0].as_py() & 0xFFFFFFFF])
            due = sum(x * s for x, s in zip(p, size))
            fixed = [x < _EPS or x > 1 - _EPS for x in p]  # of a whole rate
            short = rows.column("short").to_pylist()
            at = [i for i, x in enumerate(short) if not x]
            own = [p[i] for i in at]
            flight(own, [size[i] for i in at], rng.random(len(at) + 1))
            for i, x in zip(at, own):
                p[i] = x
            if last:
                pair_flight(p, size, at + [i for i, x in enumerate(short) if x], rng.random(len(p) + 1))
                at = [i for i, x in enumerate(fixed) if not x]
                own = [p[i] for i in at]
                landing(own, [size[i] for i in at], due - sum(p[i] * size[i] for i, x in enumerate(fixed) if x))
                for i, x in zip(at, own):
                    p[i] = x
            return rows.select(names).set_column(names.index("p"), "p", pa.array(p, pa.float64()))

        return run

    done, short, left, most = [], units.where("short"), units.where("NOT short"), targets.agg(F.coalesce(F.max("docs"), F.lit(0))).first()[0]
    level = 0
    while most > bucket_docs:  # each level leaves two of bucket_docs, so there are few
        bucket = F.pmod(F.xxhash64("__hash", "__id", F.lit(level)), F.greatest(F.ceil(F.col("docs") / F.lit(bucket_docs)), F.lit(1)))
        flown = stored(left.withColumn("__bucket", bucket).groupBy("key", "__bucket").applyInArrow(fly(False), schema), "flown")
        done.append(flown.where("p = 0 OR p = 1"))
        left = flown.where("p > 0 AND p < 1")
        counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
        left = left.drop("docs").join(counts, "key").select(*names)
        most, level = counts.agg(F.coalesce(F.max("docs"), F.lit(0))).first()[0], level + 1
    done.append(left.unionByName(short).groupBy("key").applyInArrow(fly(True), schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select(F.col("__id").alias(id_col), "__hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``copies_of`` says, all columns unchanged."""
    same = Window.partitionBy("__id", "__hash").orderBy(F.lit(0))  # equal rows of one id, told apart by number
    taken = copies_of(docs, id_col, text, source, **options).select(F.col(id_col).alias("__id"), "__hash", "copies")
    taken = taken.withColumn("__nth", F.row_number().over(same))
    rows = docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(id_col, text)}).withColumn("__nth", F.row_number().over(same))
    both = rows.alias("r").join(taken.alias("t"), F.col("r.__id").eqNullSafe(F.col("t.__id")) & (F.col("r.__hash") == F.col("t.__hash")) & (F.col("r.__nth") == F.col("t.__nth")))
    out = both.select(*[F.col(f"r.`{c}`") for c in docs.columns], F.col("t.copies").alias("__copies"))
    return out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
