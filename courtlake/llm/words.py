"""Words and word hashes of whole text columns, one numpy pass over the bytes of an Arrow batch.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; no byte of a
multi-byte UTF-8 character is one of these, so this is the code point definition
``[^\\x20\\x09-\\x0D]+`` as well.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit given."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if offsets else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs that cross none of the bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte behind each word
    first: np.ndarray  # n + 1: words before each text

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    data, at = text_bytes(column)
    start, end = runs((data - np.uint8(9) > np.uint8(4)) & (data != 32), at)  # below 9 the difference wraps around
    return Words(LOWER[data] if lower else data, start, end, np.searchsorted(start, at))


def hashes(w: Words, seed: int = 0, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, read off prefix sums taken block by block. No hash depends on the blocks; six
    numbers are held per byte of one."""
    base = mix(np.array([seed * 2 + 1], dtype=np.uint64))[0] | np.uint64(1)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    out = np.zeros(len(w.start), dtype=np.uint64)
    byte = _BYTE if not seed else mix(_BYTE + np.uint64(seed))
    k, n = 0, len(w.start)
    while k < n:  # blocks end between words
        lo = w.start[k]
        j = max(k + 1, int(np.searchsorted(w.end, lo + block, side="right")))
        hi = w.end[j - 1]
        up, down = powers(base, hi - lo + 1), powers(back, hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(byte[w.data[lo:hi]] * up[:-1], out=total[1:])
        s, e = w.start[k:j] - lo, w.end[k:j] - lo
        out[k:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        k = j
    return mix(out)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept for the next batch of this worker."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 3 << 20:
            _POWERS[int(base)] = have
    return have[:n]


def grams(h: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one text, the first word of each, and the runs before each text (one more than texts)."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    before = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], count)
    factor = mix(np.array([seed * 2 + 77], dtype=np.uint64))[0] | np.uint64(1)
    value = h[at]
    for k in range(1, n):
        value = value * factor + h[at + k]
    return mix(value), at, before


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as zstd-compressed byte planes of their differences."""
    import zstandard

    delta = np.diff(values, prepend=values.dtype.type(0))
    planes = delta.view(np.uint8).reshape(-1, 8).T if len(delta) else np.zeros((8, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype=np.uint64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64).view(dtype)


def squeeze(values: np.ndarray) -> bytes:
    """Any numbers, compressed as they stand."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def slices(batch: pa.RecordBatch, column: int, n_bytes: int = 1 << 22):
    """The batch in runs of rows of about ``n_bytes`` of the column's text, so that working memory stays bounded; a row is never cut."""
    _, at = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + n_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
