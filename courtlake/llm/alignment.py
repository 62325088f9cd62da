"""Alignment of two tokenizers over the same bytes, by lockstep merging of all documents of a batch.

Each document has one sequence of token ends per tokenizer. A NumPy vector holds the place of every document in
both; one step emits the pair of tokens at these places as a link, moves on in the sequence whose token ends
first, or in both where they end together, which is a cut; finished documents leave the vector. The links of a
*chunk* of documents (about ``chunk_bytes`` of text, whole documents) are counted per pair of ids; the counts of all
chunks are added up by Spark, and joined back once per chunk and pair, so a pair that all documents have is one
row per chunk. Texts are encoded by *segments* that neither tokenizer joins across; each distinct one of a worker is
encoded once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from courtlake.llm import words as W
from courtlake.llm.components import stored

_SPACE, _MARK = 0x20, "▁"


class Vocabulary(NamedTuple):
    """A tokenizer's bytes per id, one behind the other, and how it encodes a text that begins with a space."""

    data: np.ndarray
    start: np.ndarray  # ids + 1
    encode: Callable[[list[str]], list[list[int]]]

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.start)


def _vocabulary(pieces: list[bytes], encode) -> Vocabulary:
    start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    return Vocabulary(np.frombuffer(b"".join(pieces), np.uint8), start, encode)


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file; the strings of its special tokens are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    # Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    pieces = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    decoded = [bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p in pieces]
    return _vocabulary(decoded, lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])


def piece_level(path: str) -> Vocabulary:
    """A sentencepiece file with byte fallback, which puts a space ahead of a text by itself."""
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if t.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in ((i, t.id_to_piece(i)) for i in range(t.get_piece_size()))]
    return _vocabulary(pieces, lambda texts: t.encode([x[1:] for x in texts], num_threads=1))


class Segments(NamedTuple):
    data: np.ndarray  # bytes of all texts, each behind a space
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1: segments before each text
    clean: np.ndarray  # whether both ends are such that other clean segments may be set beside it


def segments(column: pa.Array) -> Segments:
    """Cuts before each single space between two characters that are surely no white space: ASCII ones above the space, or two-byte
    characters from U+00C0 on. Both tokenizers begin a token there whatever stands around. Null and empty texts have no segment."""
    raw, at = W.text_bytes(column)
    size = np.diff(at)
    grown = np.where(size > 0, size + 1, 0)
    to = np.concatenate([[0], np.cumsum(grown)])
    data = np.full(to[-1], _SPACE, dtype=np.uint8)
    data[np.arange(len(raw)) + np.repeat(to[:-1] + (size > 0) - at[:-1], size)] = raw
    n = len(data)
    ascii_ = (data > _SPACE) & (data < 0x7F)
    lead = (data >= 0xC3) & (data < 0xE0)
    before = ascii_.copy()
    before[1:] |= lead[:-1] & (data[1:] >= 0x80)
    behind = ascii_ | lead
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        cut[1 : n - 1] = (data[1:-1] == _SPACE) & before[:-2] & behind[2:]
    cut[to] = True
    start = np.flatnonzero(cut[:-1]) if n else np.zeros(0, np.int64)
    end = np.append(start[1:], n) if len(start) else start
    clean = (data[start] == _SPACE) & (end - start > 1) & before[end - 1] & behind[np.minimum(start + 1, max(n - 1, 0))] if n else np.zeros(0, bool)
    return Segments(data, start, end, np.searchsorted(start, to), clean)


class Cached:
    """Ids of segments, each distinct one encoded once while there is room for it."""

    def __init__(self, vocabulary: Vocabulary, most: int = 3 << 18, longest: int = 48):
        self.v, self.most, self.longest = vocabulary, most, longest
        self._clear()

    def _clear(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _encode(self, s: Segments, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these segments in order, and how many each has. Clean ones are encoded many at a time: a segment's tokens end where it ends."""
        data, lengths = s.data.tobytes(), (s.end - s.start)[which]
        joined = s.clean[which]
        ids, counts = [None] * len(which), np.zeros(len(which), dtype=np.int64)
        text = lambda k: data[s.start[k] : s.end[k]].decode()
        many = np.flatnonzero(joined)
        for lo in range(0, len(many), 256):
            part = many[lo : lo + 256]
            got = np.array(self.v.encode(["".join(text(k) for k in which[part])])[0], dtype=np.int64)
            ends, want = np.cumsum(self.v.length[got]), np.cumsum(lengths[part])
            place = np.searchsorted(ends, want) + 1
            if len(ends) and ends[-1] == want[-1] and (ends[np.minimum(place, len(ends)) - 1] == want).all():
                for k, x in zip(part.tolist(), np.split(got, place[:-1])):
                    ids[k] = x
            else:  # the bytes differ somewhere: one by one
                joined[part] = False
        alone = np.flatnonzero(~joined)
        for lo in range(0, len(alone), 256):
            part = alone[lo : lo + 256]
            for k, x in zip(part.tolist(), self.v.encode([text(k) for k in which[part]])):
                ids[k] = np.array(x, dtype=np.int64)
        counts[:] = [len(x) for x in ids]
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)).astype(np.uint16), counts

    def ids(self, s: Segments, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many there are before each text (one more than texts)."""
        if len(self.key) > self.most:
            self._clear()
        short = np.flatnonzero(s.end - s.start <= self.longest)
        key, at = np.unique(h[short], return_index=True)
        at = short[at]
        place = np.searchsorted(self.key, key)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == key[known]
        new = np.flatnonzero(~known)
        if len(new):
            flat, count = self._encode(s, at[new])
            have = len(self.start)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
            where = np.searchsorted(self.key, key[new])
            self.key, self.slot = np.insert(self.key, where, key[new]), np.insert(self.slot, where, np.arange(have, have + len(new)))
        long_ = np.flatnonzero(s.end - s.start > self.longest)
        extra, n_extra = self._encode(s, long_) if len(long_) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        source = np.concatenate([self.flat, extra])
        start, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        slot = self.slot[np.searchsorted(self.key, h[short])]
        start[short], count[short] = self.start[slot], self.count[slot]
        start[long_], count[long_] = len(self.flat) + np.cumsum(n_extra) - n_extra, n_extra
        before = np.concatenate([[0], np.cumsum(count)])
        return source[np.arange(before[-1]) + np.repeat(start - before[:-1], count)], before[s.first]


def same_bytes(s: Segments, v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: whether its tokens' bytes, joined, are the text's."""
    bounds = np.append(s.start, len(s.data))[s.first]
    length = v.length[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    right = total[at[1:]] - total[at[:-1]] == np.diff(bounds)
    take = np.repeat(right, np.diff(at))
    length, first = length[take], v.start[ids[take]]
    before = np.cumsum(length) - length
    made = v.data[np.arange(length.sum()) + np.repeat(first - before, length)]
    wrong = np.concatenate([[0], np.cumsum(made != s.data[np.repeat(right, np.diff(bounds))])])
    size = np.where(right, np.diff(bounds), 0)
    ends = np.cumsum(size)
    return right & (wrong[ends] == wrong[ends - size])


class Merged(NamedTuple):
    a: np.ndarray  # per link: its places among all A and B tokens
    b: np.ndarray
    cut_a: np.ndarray  # per token: whether a group ends with it
    cut_b: np.ndarray


def lockstep(end_a: np.ndarray, first_a: np.ndarray, end_b: np.ndarray, first_b: np.ndarray) -> Merged:
    """All links and cuts. ``end_*`` are token ends in bytes of the own document, ``first_*`` (n + 1) the tokens before each; documents
    without tokens are skipped, others must end together."""
    i, j = first_a[:-1].copy(), first_b[:-1].copy()
    last = first_a[1:]
    live = np.flatnonzero(i < last)
    i, j, last = i[live], j[live], last[live]
    la, lb = (np.empty(len(end_a) + len(end_b), np.int64) for _ in range(2))
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    n = 0
    while len(i):
        la[n : n + len(i)], lb[n : n + len(i)] = i, j
        n += len(i)
        ea, eb = end_a[i], end_b[j]
        up_a, up_b = ea <= eb, eb <= ea
        cut = up_a & up_b
        if cut.any():
            cut_a[i[cut]] = cut_b[j[cut]] = True
        i, j = i + up_a, j + up_b
        on = i < last
        if not on.all():
            i, j, last = i[on], j[on], last[on]
    return Merged(la[:n], lb[:n], cut_a, cut_b)


def _digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number's decimal digits with a place behind them for a separator, in rows of equal width, and how many digits it has."""
    text = [str(i) for i in range(top)]
    width = max(map(len, text)) + 1
    return np.frombuffer("".join(t.ljust(width) for t in text).encode(), np.uint8).reshape(top, width), np.array([len(t) for t in text])


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_digests(ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray, m: Merged) -> list[str]:
    """Per text: sha256 of its groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
    if 1 << 16 not in _DIGITS:
        _DIGITS[1 << 16] = _digits(1 << 16)
    table, size = _DIGITS[1 << 16]
    n_groups = np.cumsum(m.cut_a)
    group_a = n_groups - m.cut_a  # of each token, over all texts
    group_b = np.cumsum(m.cut_b) - m.cut_b
    # A token's place in the output: all tokens of earlier groups, and, for B, the A tokens of its own.
    na, nb = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    place_a = np.arange(len(ids_a)) + (np.cumsum(nb) - nb)[group_a] if len(ids_a) else np.zeros(0, np.int64)
    place_b = np.arange(len(ids_b)) + np.cumsum(na)[group_b] if len(ids_b) else np.zeros(0, np.int64)
    ids, sep = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    sep[place_a], sep[place_b] = np.where(m.cut_a, ord("|"), ord(",")), np.where(m.cut_b, ord(";"), ord(","))
    out, at = [], at_a + at_b
    block = 1 << 18
    sizes = np.concatenate([[0], np.cumsum(size[ids] + 1)])
    hashes = [hashlib.sha256() if hi > lo else None for lo, hi in zip(at[:-1], at[1:])]
    for lo in range(0, len(ids), block):
        hi = min(lo + block, len(ids))
        rows, length = table[ids[lo:hi]], size[ids[lo:hi]]
        rows[np.arange(hi - lo), length] = sep[lo:hi]
        text = rows[np.arange(table.shape[1]) <= length[:, None]].tobytes()
        k = int(np.searchsorted(at, lo, side="right")) - 1
        while k < len(hashes) and at[k] < hi:
            s, e = max(at[k], lo), min(at[k + 1], hi)
            if e > s:
                hashes[k].update(text[sizes[s] - sizes[lo] : sizes[e] - sizes[lo] - (e == at[k + 1])])
            k += 1
    for h in hashes:
        out.append(h.hexdigest() if h else "")
    return out


_LOADED: dict[str, Cached] = {}


def _cached(kind: Callable[[str], Vocabulary], path: str) -> Cached:
    if path not in _LOADED:
        _LOADED[path] = Cached(kind(path))
        if len(_LOADED[path].v.length) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
    return _LOADED[path]


class Aligned(NamedTuple):
    """The alignment of a batch of texts."""

    ids_a: np.ndarray
    at_a: np.ndarray  # n + 1: tokens before each text
    ids_b: np.ndarray
    at_b: np.ndarray
    merged: Merged


def align(column: pa.Array, a: Cached, b: Cached) -> Aligned:
    s = segments(column)
    h = W.hashes(W.Words(s.data, s.start, s.end, s.first)) if len(s.start) else np.zeros(0, np.uint64)
    (ids_a, at_a), (ids_b, at_b) = a.ids(s, h), b.ids(s, h)
    ok = same_bytes(s, a.v, ids_a, at_a) & same_bytes(s, b.v, ids_b, at_b)
    parts = []
    for v, ids, at in ((a.v, ids_a, at_a), (b.v, ids_b, at_b)):
        count = np.where(ok, np.diff(at), 0)
        ids = ids[np.repeat(ok, np.diff(at))]
        at = np.concatenate([[0], np.cumsum(count)])
        total = np.cumsum(v.length[ids])
        start = np.concatenate([[0], total])[at[:-1]]
        parts += [ids, at, total - np.repeat(start, count)]
    ids_a, at_a, end_a, ids_b, at_b, end_b = parts
    return Aligned(ids_a, at_a, ids_b, at_b, lockstep(end_a, at_a, end_b, at_b))


_SCAN = (
    "chunk long, place int, pair long, n long, docs array<struct<id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, "
    "sizes binary, places binary, repeats binary"
)


def scan(docs: DataFrame, id_col: str, text: str, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """Per chunk a row for each of its pairs of ids (``pair`` = A id * 65536 + B id, in order, with its links here), and one that holds its
    documents and, packed, which pairs each has and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _cached(byte_level, path_a), _cached(piece_level, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for rows in (x for batch in batches for x in W.slices(batch, 1, chunk_bytes)):
            t = align(rows.column(1), a, b)
            m, n = t.merged, rows.num_rows
            doc = np.repeat(np.arange(n), np.diff(t.at_a))[m.a]
            both = (doc.astype(np.uint64) << np.uint64(32)) | (t.ids_a[m.a].astype(np.uint64) << np.uint64(16)) | t.ids_b[m.b].astype(np.uint64)
            both.sort()
            head = np.flatnonzero(np.diff(both, prepend=~both[:1]) != 0) if len(both) else np.zeros(0, np.int64)
            times, both = np.diff(head, append=len(both)), both[head] if len(both) else both
            pair, place = np.unique((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
            count = np.bincount(place, weights=times, minlength=len(pair)).astype(np.int64)
            owner = (both >> np.uint64(32)).astype(np.int64)
            sizes = np.bincount(owner, minlength=n)
            links = np.bincount(doc, minlength=n)
            groups = np.bincount(np.repeat(np.arange(n), np.diff(t.at_a)), weights=m.cut_a, minlength=n).astype(np.int64)
            facts = [rows.column(0).cast(pa.int64()), np.diff(t.at_a), np.diff(t.at_b), groups, links, group_digests(t.ids_a, t.at_a, t.ids_b, t.at_b, m)]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            listed = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string() if i == 5 else pa.int64()) for i, x in enumerate(facts)], names)
            step = np.diff(place, prepend=0).astype(np.int32)
            planes = [np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T) if len(x) else np.zeros(0, np.uint8) for x in (step, times)]
            packed = [W.squeeze(sizes.astype(np.int32)), *(W.squeeze(x) for x in planes)]
            none = len(pair)
            lists = pa.ListArray.from_arrays(pa.array([*[0] * (none + 1), n], pa.int32()), listed)
            lists = pa.concat_arrays([pa.nulls(none, lists.type), lists.slice(none, 1)])
            yield pa.record_batch([
                pa.array(np.full(none + 1, chunk)), pa.array(np.append(np.arange(none), -1), pa.int32()), pa.array([*pair.tolist(), None], pa.int64()),
                pa.array([*count.tolist(), None], pa.int64()), lists, *(pa.array([None] * none + [x], pa.binary()) for x in packed),
            ], ["chunk", "place", "pair", "n", "docs", "sizes", "places", "repeats"])
            chunk += 1

    return docs.select(id_col, text).mapInArrow(run, _SCAN)


def best_pairs(counts: DataFrame) -> DataFrame:
    """``pair, n, best``: the links of each pair in the whole corpus, and whether no pair of the same B id has more."""
    total = counts.groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    most = total.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return total.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_tokenizer_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    Both tokenizers encode a space and the text, without special tokens. A null or empty text, or one whose tokens' bytes do not
    give it back, has no tokens: zeros and ''. Links are pairs of tokens whose bytes overlap, groups end where tokens of both end.
    ``n_best`` counts the links whose pair of ids has as many links in the corpus as any pair of its B id, ``count_sum`` adds up the
    corpus-wide links of the pair over all links. Rows of one id, equal rows and null ids are rows each. Other columns are ignored; an empty
    table gives an empty one. A text is never cut, so a chunk is at least one document.
    """
    found = stored(scan(docs, id_col, text, path_a, path_b, chunk_bytes), "links")
    pairs = found.where("pair IS NOT NULL").select("chunk", "place", "pair", "n")
    known = pairs.select("chunk", "place", "pair").join(best_pairs(pairs), "pair")
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    chunks = found.where("pair IS NULL").select("chunk", "docs", "sizes", "places", "repeats").join(known, "chunk", "left").drop("chunk")
    schema = f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(0).slice(k, 1).flatten()
                sizes = W.expand(batch.column(1)[k].as_py(), np.int32)
                step, times = (np.ascontiguousarray(W.expand(batch.column(c)[k].as_py(), np.uint8).reshape(4, -1).T).reshape(-1).view(np.int32) for c in (2, 3))
                place = np.cumsum(step)
                n, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if batch.column(4)[k].is_valid:
                    got = batch.column(4).slice(k, 1).flatten()
                    at, count, top = (got.field(f).to_numpy(zero_copy_only=False) for f in ("place", "n", "best"))
                    n, best = np.empty(len(at), np.int64), np.empty(len(at), bool)
                    n[at], best[at] = count, top
                ends = np.cumsum(sizes)
                total = [np.concatenate([[0], np.cumsum(times * x[place])]) for x in (best, n)]
                n_best, count_sum = (t[ends] - t[ends - sizes] for t in total)
                field = dict(zip((f.name for f in rows.type), rows.flatten()))
                columns = [field["id"], *(field[c] for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), field["groups_sha256"]]
                yield pa.record_batch(columns, [x.split()[0] for x in schema.split(", ")])

    return chunks.mapInArrow(sums, schema)
