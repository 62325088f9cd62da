"""Which keys of one group of documents also occur elsewhere, asked without moving a row per key.

Documents are dealt into *chunks* of a bounded size. Every chunk sends its distinct
keys, sorted and difference-coded, one blob per *bucket*; a bucket answers one
bit per key; the answers meet their chunk again, whose keys are computed a second time
in the same order. A key that a third of all documents hold costs one entry per chunk.
Chunks and buckets grow in number, not in size, with the input. The documents' exchange
is the same for the request and for the answer, so Spark reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from courtlake.llm import words as W

CHUNK, BUCKET = "__chunk", "__bucket"
_REQUEST = StructType([
    StructField(CHUNK, IntegerType()), StructField(BUCKET, IntegerType()), StructField("keys", BinaryType()),
    StructField("owners", BinaryType()), StructField("ids", BinaryType()),
])
_SHARED = StructType([StructField(CHUNK, IntegerType()), StructField(BUCKET, IntegerType()), StructField("keys", BinaryType()), StructField("many", BinaryType())])
_ANSWER = StructType([StructField(CHUNK, IntegerType()), StructField(BUCKET, IntegerType()), StructField("bits", BinaryType())])


class Keys(NamedTuple):
    """Distinct keys of a chunk in the order of (bucket, key), each with its smallest and largest owner."""

    bucket: np.ndarray
    key: np.ndarray
    owner: np.ndarray
    top: np.ndarray
    of: np.ndarray  # for every key given: its place among the distinct ones


def distinct(bucket: np.ndarray, key: np.ndarray, owner: np.ndarray) -> Keys:
    order = np.argsort(key)
    narrow = bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket  # 16 bits are sorted by radix
    order = order[np.argsort(narrow[order], kind="stable")]
    b, k, o = bucket[order], key[order], owner[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    of = np.empty(len(k), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    least, most = (f.reduceat(o, head) if len(head) else o for f in (np.minimum, np.maximum))
    return Keys(b[head], k[head], least, most, of)


def chunked(docs: DataFrame, id_col: str, chunks: int) -> DataFrame:
    """``docs`` with the number of its chunk, by the hash of its id (of the whole row where the id is null)."""
    by = F.when(F.col(id_col).isNull(), F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")])).otherwise(F.xxhash64(id_col))
    return docs.withColumn(CHUNK, F.pmod(by, F.lit(chunks)).cast("int"))


def n_chunks(docs: DataFrame, n_bytes: int, chunk_bytes: int) -> int:
    """As many chunks as keep each near ``chunk_bytes``, and work for every shuffle partition."""
    return max(1, -(-n_bytes // chunk_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ask(chunks: DataFrame, keys: Callable[[pa.Table], tuple[Keys, Any]]) -> DataFrame:
    """A row (chunk, bucket, bits) per request. A bit says that the key has a smaller owner than here."""

    def request(table: pa.Table) -> pa.Table:
        k, _ = keys(table)
        rows = []
        for bucket, lo, hi in _heads(k.bucket):
            ids = np.unique(k.owner[lo:hi])
            at = np.searchsorted(ids, k.owner[lo:hi]).astype(np.uint32)
            planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T)
            rows.append((table.column(CHUNK)[0].as_py(), int(bucket), W.pack(k.key[lo:hi]), W.squeeze(planes), W.pack(ids.view(np.uint64))))
        return _rows(rows, _REQUEST)

    def judge(table: pa.Table) -> pa.Table:
        size, part = [], []
        for blob, owners, ids in zip(*(table.column(c).to_pylist() for c in ("keys", "owners", "ids"))):
            key = W.unpack(blob)
            size.append(len(key))
            at = np.ascontiguousarray(W.expand(owners, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)
            part.append((key, W.unpack(ids, np.int64)[at]))
        key, owner = (np.concatenate(p) for p in zip(*part))
        del part, at
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yes = np.empty(len(key), dtype=bool)
        yes[order] = np.repeat(np.minimum.reduceat(owner, head), np.diff(head, append=len(key))) < owner
        return _replies(table, yes, size)

    return chunks.groupBy(CHUNK).applyInArrow(request, _REQUEST).groupBy(BUCKET).applyInArrow(judge, _ANSWER)


def ask_shared(chunks: DataFrame, keys: Callable[[pa.Table], tuple[Keys, Any]]) -> DataFrame:
    """A row (chunk, bucket, bits) per request. A bit says that the key is in another chunk too, or has several owners in one.

    Owners stay at home: what has one owner is meant to be in one chunk. An owner in several chunks has its keys called shared.
    """

    def request(table: pa.Table) -> pa.Table:
        k, _ = keys(table)
        return _rows([(table.column(CHUNK)[0].as_py(), *row) for row in shared_requests(k)], _SHARED)

    def judge(table: pa.Table) -> pa.Table:
        key, many = [W.unpack(x) for x in table.column("keys").to_pylist()], table.column("many").to_pylist()
        size = [len(x) for x in key]
        several = np.concatenate([np.unpackbits(W.expand(x, np.uint8), count=n).astype(bool) for x, n in zip(many, size)])
        key = np.concatenate(key)
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(head, append=len(key))
        yes = np.empty(len(key), dtype=bool)
        yes[order] = np.repeat((length > 1) | np.logical_or.reduceat(several[order], head), length)
        return _replies(table, yes, size)

    return chunks.groupBy(CHUNK).applyInArrow(request, _SHARED).groupBy(BUCKET).applyInArrow(judge, _ANSWER)


def shared_requests(k: Keys) -> list[tuple[int, bytes, bytes]]:
    """Per bucket: its keys, and a bit for each that several owners have."""
    return [(int(b), W.pack(k.key[lo:hi]), W.squeeze(np.packbits(k.owner[lo:hi] != k.top[lo:hi]))) for b, lo, hi in _heads(k.bucket)]


def _rows(rows: list[tuple], schema: StructType) -> pa.Table:
    kinds = _arrow(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=kinds)


def _replies(table: pa.Table, yes: np.ndarray, size: list[int]) -> pa.Table:
    bits = [W.squeeze(np.packbits(yes[e - n : e])) for e, n in zip(np.cumsum(size), size)]
    return pa.table([table.column(CHUNK), table.column(BUCKET), pa.array(bits, pa.binary())], schema=_arrow(_ANSWER))


def answered(chunks: DataFrame, answers: DataFrame, keys: Callable[[pa.Table], tuple[Keys, Any]], apply: Callable[[pa.Table, Keys, Any, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``apply(chunk's rows, its keys, what else keys() made, one answer per distinct key)`` for every chunk."""

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _arrow(schema).empty_table()
        k, made = keys(table)
        yes = np.zeros(len(k.key), dtype=bool)
        heads = {int(b): (lo, hi) for b, lo, hi in _heads(k.bucket)}
        for b, blob in zip(replies.column(BUCKET).to_pylist(), replies.column("bits").to_pylist()):
            lo, hi = heads[b]
            yes[lo:hi] = np.unpackbits(W.expand(blob, np.uint8), count=hi - lo).astype(bool)
        return apply(table, k, made, yes)

    return chunks.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(finish, schema)


def _heads(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(bucket):
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        yield from zip(bucket[at[:-1]], at[:-1], at[1:])


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
