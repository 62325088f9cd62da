"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokens come from a public tokenizer file; every distinct word of a worker's texts is encoded once.
Pieces are dealt into shards of a bounded size, each packed, its longest piece first, by bounded-space
online best-fit: a piece goes to the open bin with the least free space that holds it, found in a bitset with one bit
per free space; if too many bins are open, the fullest closes first. Only sizes are shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from courtlake.llm import words as W
from courtlake.llm.components import stored

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BREAK = "<|endoftext|>"


class WordEncoder:
    """Ids of texts by whole words. White space never joins two words into a token, so a text's ids are its words' ids in order."""

    def __init__(self, path: str, most_words: int = 3 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self.stop = self.tokenizer.token_to_id(_BREAK)
        self.clear()

    def clear(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of words, sorted, and their places
        self.start, self.count, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        """``keys`` are sorted and none is known."""
        ids, ends = [], []
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        odd = [i for i, w in enumerate(words) if "<|" in w]
        parts = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([_BREAK.join(words[i] for i in p) for p in parts], add_special_tokens=False)):
            got = np.array([*e.ids, self.stop], dtype=np.uint32)
            end = np.flatnonzero(got == self.stop)
            if len(end) != len(part):
                raise ValueError("the tokenizer does not keep its special token apart")
            ends.append((part, np.diff(end, prepend=-1) - 1))
            ids.append(got[got != self.stop])
        for i in odd:
            got = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32)
            ends.append(([i], np.array([len(got)])))
            ids.append(got)
        order = np.concatenate([p for p, _ in ends]).astype(np.int64)
        count, new = np.concatenate([c for _, c in ends]), np.concatenate(ids)
        have, n = len(self.key), len(order)
        while len(self.start) < have + n:
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while len(self.flat) < self.used + len(new):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[have : have + n] = self.used + np.cumsum(count) - count
        self.count[have : have + n] = count
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        slot = np.empty(n, dtype=np.int32)
        slot[order] = np.arange(have, have + n)
        at = np.searchsorted(self.key, keys)
        self.key, self.slot = np.insert(self.key, at, keys), np.insert(self.slot, at, slot)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column, and how many there are before each text (one more than texts)."""
        w = W.split(column)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(w.first), np.int64)
        h = W.hashes(w)
        order = np.argsort(h)
        new = np.concatenate([[True], np.diff(h[order]) != 0])
        at, key = order[new], h[order][new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.key) > self.most:
            self.clear()
        place = np.searchsorted(self.key, key)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == key[known]
        missing = np.flatnonzero(~known)
        if len(missing):
            data, s, e = w.data.tobytes(), w.start[at[missing]].tolist(), w.end[at[missing]].tolist()
            self._add(key[missing], [data[x:y].decode() for x, y in zip(s, e)])
        slot = self.slot[np.searchsorted(self.key, key)][inverse]
        count = self.count[slot]
        before = np.concatenate([[0], np.cumsum(count)])
        take = np.arange(before[-1]) + np.repeat(self.start[slot] - before[:-1], count)
        return self.flat[take], before[w.first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, its ``ids``."""
    schema = _PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in (x for batch in batches for x in W.slices(batch, 1)):
            ids, at = enc.encode(b.column(1))
            rows, parts = [], []
            for doc, lo, hi in zip(b.column(0).cast(pa.int64()).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), length)):
                    part = own[s : s + length]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
                    parts.append(part)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))))
            yield pa.record_batch(columns, [f.split()[0] for f in schema.split(", ")])

    return docs.select(id_col, text).mapInArrow(cut, schema)


def best_fit(sizes: list[int], capacity: int, most_open: int) -> tuple[list[int], list[int], int]:
    """Bin and place in it of each size, in the order given, and how many bins there are."""
    bits, bins = 0, [[] for _ in range(capacity + 1)]  # free space -> open bins
    opened, n_bins, bin_of, offset = 0, 0, [], []
    for size in sizes:
        fitting = bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = bins[free].pop()
            if not bins[free]:
                bits ^= 1 << free
            opened -= 1
        else:
            free, b, n_bins = capacity, n_bins, n_bins + 1
        bin_of.append(b)
        offset.append(capacity - free)
        free -= size
        if free:
            bins[free].append(b)
            bits |= 1 << free
            opened += 1
            if opened > most_open:
                least = (bits & -bits).bit_length() - 1
                bins[least].pop()
                if not bins[least]:
                    bits ^= 1 << least
                opened -= 1
    return bin_of, offset, n_bins


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0, shard_pieces: int = 20_000, most_open: int = 16_384, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece (and ``ids``).

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Longer ones are cut
    every ``length`` ids. Sequences have no gaps. Rows of one id are packed each on its own. Columns other
    than id and text are ignored, and an empty table gives an empty one.
    """
    cut = stored(pieces(docs, tokenizer, id_col, text, length, end_id, with_ids), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def pack(rows: pa.Table) -> pa.Table:
        by = [("length", "descending"), *((c, "ascending") for c in ("order", "doc_id", "piece", "start"))]
        rows = rows.take(pc.sort_indices(rows.select([c for c, _ in by]), sort_keys=by))
        bin_of, offset, _ = best_fit(rows.column("length").to_pylist(), length, most_open)
        first = rows.column("shard")[0].as_py() << 32
        rows = rows.drop_columns(["shard", "order"])
        return rows.append_column("sequence_id", pa.array([first + b for b in bin_of], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.withColumns({"shard": F.pmod(order, F.lit(shards)), "order": F.xxhash64(order)})
    schema = _PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    out = dealt.groupBy("shard").applyInArrow(pack, schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
