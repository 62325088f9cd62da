"""Substring dedup: passages that a document with a smaller id has too, found in prefix-partitioned suffix trees.

A suffix is the word sequence from one word to the text's end. Suffixes are split into
groups by a prefix of 1, 2, 4 ... words: as many as it takes for the group to stay under
``group_suffixes``; the group's size is read off counts of all prefixes of the corpus, kept
in a fixed number of hashed cells (a cell bounds each of its prefixes from above). At full
depth, ``min_words`` words, a group is one path of the tree and needs no further split: it
has one leaf per chunk. Within a group the tree is cut at that depth: only its deep internal
nodes matter, and those are the runs of equal leaves among the group's sorted leaves. A leaf
stands for its path by a 64-bit fingerprint. Consecutive words of one document whose suffixes
meet in deep nodes give its maximal repeats; words of windows whose node also has a leaf of a
smaller document go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from courtlake.llm import exchange as X, words as W

CELLS = 8192
_COUNTS = "level int, cell int, n long"


def _levels(min_words: int) -> list[int]:
    return [*(d for d in (1, 2, 4, 8) if d < min_words), min_words]


def prefix_counts(docs: DataFrame, text: str, min_words: int) -> tuple[np.ndarray, int, int]:
    """Suffixes per (level, cell), all suffixes, and bytes of text; a table of fixed size, summed before the shuffle."""
    levels = _levels(min_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_bytes = np.zeros((len(levels), CELLS), dtype=np.int64), 0
        for b in (x for batch in batches for x in W.slices(batch, 0)):
            w = W.split(b.column(0))
            n_bytes += len(w.data)
            h = W.hashes(w)
            _, at, _ = W.grams(h, w.first, min_words)
            for i, d in enumerate(levels):
                total[i] += np.bincount(_prefix(h, at, d) % np.uint64(CELLS), minlength=CELLS)
        i, cell = np.nonzero(total)
        yield pa.record_batch([
            pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(cell, 0), pa.int32()), pa.array(np.append(total[i, cell], n_bytes), pa.int64()),
        ], ["level", "cell", "n"])

    table, n_bytes = np.zeros((len(levels), CELLS), dtype=np.int64), 0
    for r in docs.select(text).mapInArrow(count, _COUNTS).groupBy("level", "cell").agg(F.sum("n").alias("n")).collect():
        if r.level < 0:
            n_bytes = r.n
        else:
            table[r.level, r.cell] = r.n
    return table, int(table[0].sum()), n_bytes


def _prefix(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    value = h[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, depth):
        value = value * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return W.mix(value)


def _groups(h: np.ndarray, at: np.ndarray, counts: np.ndarray, levels: list[int], group_suffixes: int) -> np.ndarray:
    """The hash of each suffix's group: of its shortest prefix that few enough suffixes have."""
    group, left = np.zeros(len(at), dtype=np.uint64), np.arange(len(at))
    for i, d in enumerate(levels):
        p = _prefix(h, at[left], d)
        small = (counts[i][p % np.uint64(CELLS)] <= group_suffixes) | (i == len(levels) - 1)
        group[left[small]] = p[small]
        left = left[~small]
    return group


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 13, group_suffixes: int = 1_000_000, chunk_bytes: int = 8_000_000) -> DataFrame:
    """``docs`` without the words that repeat a passage of a smaller id; every row stays.

    Added: ``n_words``, ``n_removed`` (words before, words removed), ``kept_sha256`` (hex digest of the
    kept words joined by one space) and ``repeats``, the maximal repeats as [first word, word behind the
    last]. ``text`` keeps the white space before each kept word, unchanged if nothing goes. A null text has
    no words and stays null; texts under ``min_words`` words lose nothing; rows of one id never take words
    from each other; a null id counts as larger than all others. Columns of these names are replaced;
    others pass through. An empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "repeats")
    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("repeats", ArrayType(ArrayType(LongType())))])
    counts, suffixes, n_bytes = prefix_counts(docs, text, min_words)
    levels = _levels(min_words)
    buckets = np.uint64(max(-(-suffixes // group_suffixes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    chunks = X.chunked(docs, id_col, X.n_chunks(docs, n_bytes, chunk_bytes))

    def leaves(table: pa.Table) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w = W.split(table.column(text))
        h = W.hashes(w)
        leaf, at, before = W.grams(h, w.first, min_words)
        ids = table.column(id_col).cast(pa.int64()).combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        return w, h, leaf, at, np.repeat(ids, np.diff(before))

    def keys(table: pa.Table) -> tuple[X.Keys, tuple]:
        w, h, leaf, at, owner = leaves(table)
        return X.distinct((_groups(h, at, counts, levels, group_suffixes) % buckets).astype(np.int32), leaf, owner), (w, at, owner)

    def cut(table: pa.Table, k: X.Keys, made: tuple, elsewhere: np.ndarray) -> pa.Table:
        w, at, owner = made
        gone = elsewhere[k.of] | (k.owner[k.of] < owner) if len(at) else np.zeros(0, bool)
        edge = np.zeros(len(w.start) + 1, dtype=np.int64)  # +1 where a removed window starts, -1 behind its last word
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + min_words, -1)
        covered = np.cumsum(edge[:-1]) > 0
        n_words = np.diff(w.first)
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        first, behind = W.runs(covered, np.minimum(w.first, len(covered)))
        data, offsets = w.data.tobytes(), W.text_bytes(table.column(text))[1]
        texts, digests, repeats = table.column(text).to_pylist(), [], []
        lo = np.searchsorted(first, w.first)
        for i in range(table.num_rows):
            a, b = w.first[i], w.first[i + 1]
            kept = np.arange(a, b)[~covered[a:b]] if removed[i] else np.arange(a, b)
            s, e = w.start[kept], w.end[kept]
            digests.append(hashlib.sha256(_joined(w.data, s, e)).hexdigest())
            repeats.append([[int(x - a), int(y - a)] for x, y in zip(first[lo[i] : lo[i + 1]], behind[lo[i] : lo[i + 1]])])
            if removed[i]:
                from_ = np.where(kept > a, w.end[np.maximum(kept - 1, 0)], offsets[i])
                texts[i] = b"".join(data[x:y] for x, y in _spans(from_, e)).decode().lstrip(" \t\n\v\f\r")
        out = table.drop_columns([X.CHUNK])
        out = out.set_column(out.schema.get_field_index(text), text, pa.array(texts, out.schema.field(text).type))
        added = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(repeats, pa.list_(pa.list_(pa.int64())))]
        return pa.table([*out.columns, *added], schema=X._arrow(schema))

    return X.answered(chunks, X.ask(chunks, keys), keys, cut, schema)


def _spans(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Adjoining spans as one."""
    if len(start):
        new = np.flatnonzero(start[1:] != end[:-1]) + 1
        yield from zip(start[np.concatenate([[0], new])].tolist(), end[np.concatenate([new - 1, [len(end) - 1]])].tolist())


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words joined by one space, cut out of the bytes in one step."""
    if not len(start):
        return b""
    size = end - start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = data[np.minimum(take, len(data) - 1)]
    out[at[1:] - 1] = 32
    return out[:-1].tobytes()
