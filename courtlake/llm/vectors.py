"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them, one kept per group.

Centroids are fitted to a bounded sample; every vector is indexed. It is at home in the cell of its nearest
centroid and a guest in every cell it might have a partner in: partners lie within ``r`` = sqrt(2 - 2 * threshold),
so y can only have one in the cell of c if y.(c' - c) <= r * |c' - c| for every other centroid c'. Each vector's
links are counted in its home cell, against homes and guests, so no link is lost, whatever the centroids. Where the
data have no clusters this bound excludes little: then there are fewer cells, down to one, since guests would only be
copies of most vectors in most cells, and the work is that of all pairs in blocks.

Cells are cut into tiles, and the home tiles of a cell are dealt to stacks of bounded size. A stack is held by one task, past
which go the guest tiles and, of each two stacks, the tiles of one: a tile is sent to half of the cell's stacks, not to each other tile. Products
are in single precision; what comes near the threshold is computed in double precision. Equal vectors are one node with a
multiplicity. A product gives link counts and, in place of its pairs, the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from courtlake.llm.components import components, drop_stored, stored


def unit_rows(column: pa.Array, dtype: str) -> list[bytes | None]:
    """The components of each vector that can link, as bytes; else None."""
    out = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=dtype)
            y = x.astype(np.float64)
            if not np.isfinite(y).all() or not y.any() or not np.isfinite(y @ y) or y @ y == 0:
                x = None
        out.append(None if x is None else x.tobytes())
    return out


def normal(vectors: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=dtype).reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Unit centroids; the first are spread over the sample, and an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def reach(y: np.ndarray, apart: np.ndarray, radius: float) -> np.ndarray:
    """Which cells each vector might have a partner in, from its products with the centroids."""
    may = np.ones(y.shape, dtype=bool)
    for other in range(y.shape[1]):
        may &= y[:, [other]] - y <= radius * apart[other] + 1e-12
    return may


def centroids(x: np.ndarray, most: int, radius: float, most_places: float = 4) -> tuple[np.ndarray, np.ndarray]:
    """As many centroids as pay, and their distances: a vector is in ``most_places`` cells at most, and in no more than half of them, on average over a
    thousand of the sample."""
    some, k = x[np.linspace(0, len(x) - 1, min(len(x), 1000)).astype(int)], most
    while True:
        c = spherical_kmeans(x, k)
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0))
        places = reach(some @ c.T, apart, radius).sum(axis=1).mean() if k > 1 else 0
        if places <= min(most_places, k / 2):
            return c, apart
        k //= 2


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, cell_vectors: int = 16_000, most_cells: int = 1000, sample: int = 20_000, tile: int = 4096, stack_bytes: int = 1 << 26) -> DataFrame:
    """``id, n_links, component_id, kept`` per row: links are cosines of at least ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing:
    their component is their id (so a null id stays null and is kept). Rows of equal vectors link. Vectors of different
    lengths don't. Other columns are ignored; an empty table gives an empty one.
    """
    kind = vectors.schema[vector].dataType
    dtype = "<f8" if isinstance(kind, ArrayType) and kind.elementType.typeName() == "double" else "<f4"
    if dtype == "<f4":
        vectors = vectors.withColumn(vector, F.col(vector).cast("array<float>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = unit_rows(b.column(1), dtype)
            packed = [None if i is None else p for i, p in zip(b.column(0).to_pylist(), packed)]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(packed, pa.binary())], ["id", "vec"])

    rows = stored(vectors.select(id_col, vector).mapInArrow(pack, "id long, vec binary"), "vectors")
    nodes = rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "nodes")
    lengths = nodes.groupBy(F.length("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    length, n = lengths[0]
    fitted = nodes.where(F.length("vec") == length).orderBy(F.xxhash64("vec"), "node").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    x = normal(fitted, dtype)
    radius = np.sqrt(2 - 2 * threshold) + 1e-9
    c, apart = centroids(x, max(1, min(most_cells, -(-n // cell_vectors), len(x))), radius)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, take, guest = [], [], []
            vec, usual = b.column("vec").to_pylist(), []
            for i, v in enumerate(vec):
                if len(v) == length:
                    usual.append(i)
                else:
                    cells.append(np.array([-len(v)])), take.append(np.array([i])), guest.append(np.array([False]))
            if usual:
                y = normal([vec[i] for i in usual], dtype) @ c.T
                may = reach(y, apart, radius)
                home = y.argmax(axis=1)
                may[np.arange(len(home)), home] = True
                i, cell = np.nonzero(may)
                cells.append(cell), take.append(np.array(usual)[i]), guest.append(cell != home[i])
            at = pa.array(np.concatenate(take))
            yield pa.record_batch([
                pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(guest)), b.column("node").take(at), b.column("copies").take(at), b.column("vec").take(at)
            ], ["cell", "guest", "node", "copies", "vec"])

    placed = stored(nodes.select("node", "copies", "vec").mapInArrow(assign, "cell int, guest boolean, node long, copies long, vec binary"), "placed")
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"), F.max(F.length("vec")).alias("length"))
    per_cell, group, spark = [], 0, vectors.sparkSession
    sizes = sorted(tuple(r) for r in sizes.collect())  # a row per cell
    every = max(1, sum(homes for _, homes, _, _ in sizes))
    for cell, homes, guests, width in sizes:
        tiles, least = -(-homes // tile), -(-homes * width // stack_bytes)
        stacks = min(tiles, max(least, -(-2 * spark.sparkContext.defaultParallelism * homes // every)))
        per_cell.append((cell, tiles, -(-guests // tile), stacks, group))
        group += stacks
    per_cell = spark.createDataFrame(per_cell, "cell int, homes int, guests int, stacks int, first int")

    def block(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy())
        t = t.take(pa.array(order))
        return pa.table({
            "cell": t.column("cell")[:1], "place": t.column("place")[:1], "nodes": pa.array([t.column("node").to_numpy().tobytes()], pa.binary()),
            "copies": pa.array([t.column("copies").to_numpy().tobytes()], pa.binary()), "vecs": pa.array([b"".join(t.column("vec").to_pylist())], pa.binary()),
        })

    # Places 0 .. homes - 1 are home tiles, those behind them guest tiles.
    at = F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("node"), F.greatest("guests", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("homes", F.lit(1))))
    dealt = placed.join(per_cell, "cell").select("cell", at.cast("int").alias("place"), "node", "copies", "vec")
    packed = stored(dealt.groupBy("cell", "place").applyInArrow(block, "cell int, place int, nodes binary, copies binary, vecs binary"), "tiles")
    drop_stored(placed)
    # The home tiles of stack q go past stack s too if q is among the half of all stacks that follow s around the circle.
    sent = packed.join(per_cell, "cell").where("stacks > 0").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("stacks") - 1)))
    sent = sent.withColumn("q", F.when(F.col("place") < F.col("homes"), F.col("place") % F.col("stacks"))).withColumn("d", F.pmod(F.col("q") - F.col("s"), F.col("stacks")))
    sent = sent.withColumn("kind", F.expr("CASE WHEN q IS NULL THEN 2 WHEN d = 0 THEN 0 WHEN 2 * d < stacks OR 2 * d = stacks AND s < q THEN 1 END")).where("kind IS NOT NULL")
    sent = sent.select((F.col("first") + F.col("s")).alias("stack"), "kind", "nodes", "copies", "vecs")
    sent = sent.repartitionById(max(group, 1), "stack").sortWithinPartitions("stack", "kind")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, home = None, [], None
        for b in batches:
            for stack, kind, *parts in zip(*(b.column(k) for k in ("stack", "kind", "nodes", "copies", "vecs"))):
                if stack.as_py() != held:  # the last stack has met all its tiles
                    if own:
                        yield from _Stack(own, dtype, threshold).within()
                    held, own, home = stack.as_py(), [], None
                if kind.as_py() == 0:
                    own.append(tuple(x.as_py() for x in parts))
                    continue
                if own:
                    home, own = _Stack(own, dtype, threshold), []
                    yield from home.within()
                if home is not None:
                    yield from home.against(tuple(x.as_py() for x in parts), both=kind.as_py() == 1)
        if own:
            yield from _Stack(own, dtype, threshold).within()

    batch, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(batch, "16")  # a row is a tile
    try:
        found = stored(sent.mapInArrow(multiply, "node long, n long, other long"), "products")
    finally:
        spark.conf.set(batch, before)
    drop_stored(packed)
    links = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(links, "node", "left").join(roots, "node", "left").select("vec", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("root", "node").alias("root"))
    joined = rows.where("vec IS NOT NULL").join(known, "vec").select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id"))
    out = joined.unionAll(rows.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


class _Stack:
    """Home tiles (nodes, copies, vectors as bytes) of one task, and their products with tiles that go past."""

    def __init__(self, tiles: list[tuple[bytes, bytes, bytes]], dtype: str, threshold: float):
        self.tiles, self.dtype, self.threshold = tiles, dtype, threshold
        self.node, self.copies, self.raw, self.norm, self.unit = self._open(tuple(b"".join(x) for x in zip(*tiles)))

    def _open(self, tile: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, ...]:
        node, copies = (np.frombuffer(x, dtype=np.int64) for x in tile[:2])
        raw = np.frombuffer(tile[2], dtype=self.dtype).reshape(len(node), -1)
        norm, unit = np.empty((len(node), 1)), np.empty(raw.shape, dtype=np.float32)
        for i in range(0, len(node), 4096):
            x = raw[i : i + 4096].astype(np.float64)
            norm[i : i + 4096] = np.sqrt((x * x).sum(axis=1, keepdims=True))
            unit[i : i + 4096] = x / norm[i : i + 4096]
        return node, copies, raw, norm, unit

    def within(self) -> Iterator[pa.RecordBatch]:
        for tile in self.tiles:
            yield from self.against(tile, both=False)
        self.tiles = []

    def against(self, tile: tuple[bytes, bytes, bytes], both: bool) -> Iterator[pa.RecordBatch]:
        """Links of the held vectors with those of the tile; if ``both``, those count for the tile's vectors as well."""
        node, copies, raw, norm, unit = self._open(tile)
        z = unit.T
        for s in range(0, len(self.node), 512):
            links = self.unit[s : s + 512] @ z >= self.threshold - 1e-4
            for lo in range(0, len(links) if links.any() else 0, 64):  # the exact products, of a few rows at a time
                i, j = np.nonzero(links[lo : lo + 64])
                for k in range(0, len(i), 1 << 14):
                    p, q = i[k : k + (1 << 14)] + lo, j[k : k + (1 << 14)]
                    a, b = self.raw[s + p].astype(np.float64) / self.norm[s + p], raw[q].astype(np.float64) / norm[q]
                    links[p, q] = (a * b).sum(axis=1) >= self.threshold
            own = self.node[s : s + 512]
            links &= own[:, None] != node[None]
            if links.any():
                yield _forest(own, node, links, links @ copies, self.copies[s : s + 512] @ links if both else None)


def _forest(rows: np.ndarray, columns: np.ndarray, links: np.ndarray, count: np.ndarray, count_columns: np.ndarray | None = None) -> pa.RecordBatch:
    """Link counts of the rows, and of the columns if given, and (node, smallest node of its component within these links) for every linked node."""
    some_r, some_c = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    m = links[np.ix_(some_r, some_c)]
    most = np.iinfo(np.int64).max
    r, c = rows[some_r].copy(), columns[some_c].copy()
    changed = len(some_r) > 0
    while changed:
        new_r = np.minimum(r, np.where(m, c[None], most).min(axis=1))
        new_c = np.minimum(c, np.where(m, new_r[:, None], most).min(axis=0))
        changed = bool((new_r != r).any() or (new_c != c).any())
        r, c = new_r, new_c
    node = np.concatenate([rows[some_r], rows[some_r], columns[some_c]])
    n = np.concatenate([count[some_r], np.zeros(len(some_r), np.int64), np.zeros(len(some_c), np.int64) if count_columns is None else count_columns[some_c]])
    other = np.concatenate([np.zeros(len(some_r), np.int64), r, c])
    is_edge = np.concatenate([np.zeros(len(some_r), bool), r != rows[some_r], c != columns[some_c]])
    keep = is_edge | (n > 0)
    return pa.record_batch([pa.array(node[keep], pa.int64()), pa.array(n[keep], pa.int64()), pa.array(other[keep], pa.int64(), mask=~is_edge[keep])], ["node", "n", "other"])
