"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

A word's letters are counted in ``DIMS`` classes of code points, each count up to ``TOP``. A replaced letter moves the counts by an L1
distance of two at most, an inserted or deleted one by one. Counts are written in unary, all in one 64-bit number, so that the L1 distance of two
points, or of a point and a box, is a number of bits. Words of one length form k-d trees: a top tree, fitted on a bounded sample, deals all
words into cells of a bounded expected size; a word also goes as a guest to the cells of its own length whose box is within two of it
and to those of the next length within one. In each cell a second tree over its words, with the boxes of its actual
points, answers all guests at once, and the order of the letters decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from courtlake.llm import words as W
from courtlake.llm.components import stored

DIMS, TOP = 21, 3
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``word``, a row per run of letters, A-Z lower-cased. With h the crc32 of ``<id>:<run>``, a run for which ``every`` divides h loses its
    code point ``h % length``. A null text has none; a null id counts as an empty one."""
    run = F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run")
    out = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run)
    out = out.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return out.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """The distinct words of at least so many code points and occurrences, and ``n``, those of each."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def points(text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (a row per word, zeros behind its end), lengths, and letter counts in unary: bit ``TOP * d + v`` says that class d counts over v."""
    size = np.array([len(t) for t in text], dtype=np.int64)
    width = max(int(size.max()), 1) if len(size) else 1
    flat = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32)
    chars = np.zeros((len(text), width), dtype=np.uint32)
    row = np.repeat(np.arange(len(text)), size)
    chars[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    counts = np.bincount(row * DIMS + flat % DIMS, minlength=len(text) * DIMS).reshape(-1, DIMS)
    code = np.zeros(len(text), dtype=np.uint64)
    for d in range(DIMS):
        code |= ((np.uint64(1) << np.minimum(counts[:, d], TOP).astype(np.uint64)) - np.uint64(1)) << np.uint64(TOP * d)
    return chars, size, code


def has(code: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    return (code >> np.asarray(bit).astype(np.uint64)) & np.uint64(1) == 1


class Tree(NamedTuple):
    """A k-d tree; a node's children are ``low`` and ``low + 1``, leaves have none (-1) and hold ``order[first:last]``."""

    bit: np.ndarray  # points that have it go to the upper child: their count of its class is over its value
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray
    floor: np.ndarray  # boxes, as points
    ceiling: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            at = np.flatnonzero(self.low[node] >= 0)
            if not len(at):
                return node
            n = node[at]
            node[at] = self.low[n] + has(x[at], self.bit[n])

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row of x, leaf) whose L1 distance to the leaf's box is within the row's radius."""
        row, node, out = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), []
        while len(row):
            p = x[row]
            near = np.bitwise_count(self.floor[node] & ~p) + np.bitwise_count(p & ~self.ceiling[node]) <= radius[row]
            row, node = row[near], node[near]
            leaf = self.low[node] < 0
            out.append((row[leaf], node[leaf]))
            row, node = np.repeat(row[~leaf], 2), np.repeat(self.low[node[~leaf]], 2)
            node[1::2] += 1
        return np.concatenate([r for r, _ in out] or [row]), np.concatenate([k for _, k in out] or [node])


def grow(x: np.ndarray, most: int, tight: bool) -> Tree:
    """Splits at the count that halves a node best until a leaf has at most ``most`` points or all are the same. Boxes are those of the points, or,
    unless ``tight``, all that the splits leave open, so that points unseen fit too."""
    every = np.uint64((1 << TOP * DIMS) - 1)
    bits, order = np.stack([has(x, b) for b in range(TOP * DIMS)], axis=1) if len(x) else np.zeros((0, TOP * DIMS), bool), np.arange(len(x))
    nodes: list = [None]
    todo = [(0, 0, len(x), np.uint64(0), every)]
    while todo:
        k, first, last, floor, ceiling = todo.pop()
        part = order[first:last]
        bit, low = 0, -1
        if last - first > most:
            set_ = bits[part].sum(0)
            bit = int(np.argmin(np.abs(2 * set_ - len(part))))
            if 0 < set_[bit] < len(part):
                up = bits[part, bit]
                order[first:last] = np.concatenate([part[~up], part[up]])
                mid, low = last - int(set_[bit]), len(nodes)
                nodes += [None, None]
                d, v = divmod(bit, TOP)
                under = np.uint64(((1 << TOP) - 1 >> v << v) << TOP * d)  # the bits of counts over v
                upto = np.uint64(((1 << v + 1) - 1) << TOP * d)
                todo += [(low, first, mid, floor, ceiling & ~under), (low + 1, mid, last, floor | upto, ceiling)]
        if tight and last > first:
            floor, ceiling = np.bitwise_and.reduce(x[order[first:last]]), np.bitwise_or.reduce(x[order[first:last]])
        nodes[k] = (bit, low, first, last, floor, ceiling)
    b, low, f, t, floor, ceiling = zip(*nodes)
    return Tree(*(np.array(c, dtype=np.int64) for c in (b, low, f, t)), order, np.array(floor, np.uint64), np.array(ceiling, np.uint64))


def one_edit(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the rows (code points) differ by exactly one replaced one, or one that the second has more."""
    width = max(a.shape[1], b.shape[1]) + 1
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    same = a == b
    head = np.where(same.all(1), width, np.argmin(same, axis=1))  # the first difference
    equal = (~same).sum(1) == 1
    shifted = a[:, :-1] == b[:, 1:]
    tail = np.where(shifted.all(1), 0, width - 1 - np.argmin(shifted[:, ::-1], axis=1))  # from there on one is the other, moved by one
    return np.where(size_a == size_b, equal, (size_b == size_a + 1) & (head >= np.minimum(tail, size_a)))


def tops(words: DataFrame, sample: int, cell: int) -> dict[int, Tree]:
    """A top tree per length, fitted on about ``sample`` words, chosen by hash (all if there are fewer); leaves hold about ``cell`` of all words."""
    total = words.count()
    every = -(-total // sample) if total else 1
    seen = sorted(r.word for r in words.select("word").where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).collect())
    if not seen:
        return {}
    most = max(1, min(cell, cell * len(seen) // total))
    _, size, x = points(seen)
    return {int(s): grow(x[size == s], most, False) for s in np.unique(size)}


_DEALT = "length int, cell int, guest boolean, word string, n long"


def deal(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every word in its own cell, and as a guest in all cells where a word one edit away may be: of its length from its own cell on
    (a pair of two cells is looked for in one of them), and of the next length. A length without a tree has one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in (b.slice(k, 1 << 14) for k in range(0, b.num_rows, 1 << 14))):
            _, size, x = points(batch.column(0).to_pylist())
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                out = []
                for length in (s, s + 1):
                    tree = trees.get(length)
                    if tree is None:
                        row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    else:
                        row, cell = tree.reached(x[at], np.full(len(at), 2 if length == s else 1))
                        home = tree.leaf_of(x[at])
                    if length == s:
                        later = cell >= home[row]
                        out.append((length, np.arange(len(at)), home, False))
                        row, cell = row[later], cell[later]
                    out.append((length, row, cell, True))
                for length, row, cell, guest in out:
                    rows = batch.take(pa.array(at[row]))
                    yield pa.record_batch([pa.array(np.full(len(row), length), pa.int32()), pa.array(cell, pa.int32()), pa.array(np.full(len(row), guest)), rows.column(0), rows.column(1)], ["length", "cell", "guest", "word", "n"])

    return words.select("word", "n").mapInArrow(run, _DEALT)


def near_words(words: DataFrame, sample: int = 50_000, cell: int = 20_000, leaf: int = 24, tile: int = 100_000) -> DataFrame:
    """``a, na, b, nb``: every unordered pair of words one edit apart, once, with their ``n``.

    ``words`` holds distinct words and ``n``. ``tile`` bounds the guests that one task compares with a cell: a cell with more of them is
    dealt to several tasks, each with all words of the cell.
    """
    dealt = stored(deal(words, tops(words, sample, cell)), "cells")
    tiles = dealt.where("guest").groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = dealt.join(tiles, ["length", "cell"])
    tile_of = F.when(F.col("guest"), F.array(F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("tile", F.explode(tile_of)).select("length", "cell", "tile", "guest", "word", "n")

    def search(table: pa.Table) -> pa.Table:
        guest = table.column("guest").to_numpy()
        text, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        own, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        chars, size, x = points(text)
        found = [np.zeros((0, 2), np.int64)]
        if len(own) and len(guests):
            tree = grow(x[own], leaf, True)
            radius = np.where(size == size[own[0]], 2, 1)
            members = own[tree.order]
            for lo in range(0, len(guests), 1 << 13):
                g = guests[lo : lo + (1 << 13)]
                row, node = tree.reached(x[g], radius[g])
                count = tree.last[node] - tree.first[node]
                step = max(1, (1 << 19) // max(int(count.max()), 1)) if len(count) else 1
                for k in range(0, len(row), step):
                    c = count[k : k + step]
                    q = np.repeat(g[row[k : k + step]], c)
                    p = members[np.arange(c.sum()) + np.repeat(tree.first[node[k : k + step]] - np.cumsum(c) + c, c)]
                    ok = np.bitwise_count(x[q] ^ x[p]) <= radius[q]
                    q, p = q[ok], p[ok]
                    ok = one_edit(chars[q], size[q], chars[p], size[p])
                    found.append(np.stack([q[ok], p[ok]], axis=1))
        at = np.concatenate(found)
        a, b = at[:, 0], at[:, 1]
        words_ = np.array(text, dtype=object)
        out = pa.table({"a": pa.array(words_[a], pa.string()), "na": pa.array(n[a], pa.int64()), "b": pa.array(words_[b], pa.string()), "nb": pa.array(n[b], pa.int64())})
        return out

    pairs = dealt.groupBy("length", "cell", "tile").applyInArrow(search, "a string, na long, b string, nb long")
    # Two words of one length and one cell find each other from both sides.
    return pairs.where(F.length("a") < F.length("b")).unionAll(
        pairs.where(F.length("a") == F.length("b")).select(
            F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct())


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = 5, least_n: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``vocabulary(occurrences(docs))``.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the one of largest n, ties by the smallest in
    code-point order, if that n is at least ``times`` the word's own, else null. ``root`` is the last of the chain of forms; n grows along it, so
    it ends. Null and empty texts have no words; repeated rows count again; other columns are ignored; an empty table gives an empty one.
    """
    words = stored(vocabulary(occurrences(docs, id_col, text, every), least_length, least_n), "vocabulary")
    pairs = stored(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    has = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    found = stored(found.select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")

    # Each round every word takes over the root that its root has got, so chains halve.
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        step = stored(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
