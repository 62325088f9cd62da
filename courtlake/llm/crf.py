"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its potential depends on features of the line and of the lines
before and behind it, and on the label before. Weights are fitted by Adam on the exact gradient (forward-backward)
to a bounded sample of labelled documents, whose lines take the document's label. A document's score is
the mean of its lines' forward-backward marginals of being good, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from courtlake.llm import words as W

OWN = ["words", "word_bytes", "symbols", "some_symbols", "bars", "upper", "mostly_upper", "digits", "some_digits", "marks", "ends", "seen", "again", "often_again", "short", "long"]
N_FEATURES = 3 * len(OWN) + 3


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _BAR, _UPPER = _class("#*$%&|<>"), _class("|"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT, _MARK, _END = _class("0123456789"), _class("!?"), _class(".!?:;")


class Lines(NamedTuple):
    x: np.ndarray  # lines x N_FEATURES, float32
    weight: np.ndarray  # characters
    first: np.ndarray  # n + 1: lines before each text


def lines(column: pa.Array | pa.ChunkedArray) -> Lines:
    data, at = W.text_bytes(column)
    start, end = W.runs(data != 10, at)
    inside = (data - np.uint8(9) > np.uint8(4)) & (data != 32)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    word_bytes = total(inside)
    has = word_bytes[end] > word_bytes[start]
    start, end = start[has], end[has]
    first = np.searchsorted(start, at)
    n = len(start)
    count = lambda table: (lambda c: c[end] - c[start])(total(table[data]))
    w = W.split(column)
    h = W.hashes(w)
    lo = np.searchsorted(w.start, start)
    hi = np.searchsorted(w.start, end)
    words = np.maximum(hi - lo, 1)
    same = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 1:
        same[2:] = np.cumsum(h[1:] == h[:-1])
    again = same[hi] - same[np.minimum(lo + 1, hi)]
    letters = np.maximum(word_bytes[end] - word_bytes[start], 1)
    # a line seen before in its text: equal runs of words
    line_hash = np.zeros(n, dtype=np.uint64)
    if n:
        weighted = W.mix(h + (np.arange(len(h), dtype=np.uint64) - np.repeat(lo, hi - lo).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        line_hash = W.mix(np.add.reduceat(weighted, lo) + words.astype(np.uint64))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = line_hash ^ W.mix(text.astype(np.uint64) + np.uint64(1))
    seen = np.ones(n, dtype=bool)
    seen[np.unique(key, return_index=True)[1]] = False
    last = data[w.end[np.maximum(hi - 1, 0)] - 1] if n else data[:0]
    symbols, bars, upper, digits, marks = (count(t) for t in (_SYMBOL, _BAR, _UPPER, _DIGIT, _MARK))
    own = np.column_stack([
        np.log1p(words) / 8, np.minimum(letters / words, 30) / 10, symbols / letters, symbols > 0.03 * letters, bars > 0.15 * words, upper / letters, upper > 0.5 * letters,
        digits / letters, digits > 0.2 * letters, marks > 0.02 * letters, _END[last], seen, again / words, again > 0.2 * words, words < 4, words > 100,
    ]).astype(np.float32).reshape(n, len(OWN))
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    is_first, is_last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    full = np.flatnonzero(np.diff(first))
    is_first[first[full]] = is_last[first[full + 1] - 1] = True
    before[is_first], behind[is_last] = 0, 0
    chars = total((data & 0xC0) != 0x80)
    x = np.column_stack([own, before, behind, np.ones(n), is_first, is_last]).astype(np.float32)
    return Lines(x, (chars[end] - chars[start]).astype(float), first)


class Model(NamedTuple):
    node: np.ndarray  # weights of the features for good
    edge: np.ndarray  # 2 x 2: label before, label
    prior: float  # score of a text without lines


def marginals(node: np.ndarray, edge: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) per line, expected counts of label pairs, and the log-partition; ``node``: score of good per line.
    All chains take a step together, longest first."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    top = np.maximum(node, 0)
    e = np.stack([np.exp(-top), np.exp(node - top)], axis=1)
    t = np.exp(edge)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    log_z = float(top.sum())
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than the step
    for k in range(steps):
        at = begin[: live[k]] + k
        a = e[at] if k == 0 else e[at] * (alpha[at - 1] @ t)
        s = a.sum(axis=1, keepdims=True)
        alpha[at] = a / s
        log_z += float(np.log(s).sum())
    for k in range(steps - 1, 0, -1):
        at = begin[: live[k]] + k
        b = (e[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(node), dtype=bool)
    inner[begin[size > 0]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * t[None] * (e[at] * beta[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pair.sum(axis=0), log_z


def fit(x: np.ndarray, label: np.ndarray, first: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Weights from lines and their documents' labels (one per document)."""
    y = np.repeat(label, np.diff(first)).astype(float)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    x = x.astype(float)
    for k in range(1, steps + 1 if len(y) else 1):
        p, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), float(label.mean()) if len(label) else 0.5)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 3000) -> Model:
    """A model of at most ``sample`` labelled documents, those of the smallest hashes of their ids, whole texts."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id").select("__id", "__y", "__text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, 2)):
            l = lines(b.column(2))  # noqa: E741
            parts = [l.x[i:j].tobytes() for i, j in zip(l.first[:-1], l.first[1:])]
            yield pa.record_batch([b.column(0).cast(pa.string()), b.column(1), pa.array(parts, pa.binary())], ["id", "y", "x"])

    got = sorted(map(tuple, rows.mapInArrow(describe, "id string, y double, x binary").orderBy(F.xxhash64("id"), "id").limit(sample).collect()))
    x = [np.frombuffer(r[2], dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(r) for r in x])]).astype(np.int64)
    return fit(np.concatenate(x) if x else np.zeros((0, N_FEATURES), np.float32), np.array([r[1] for r in got]), first)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1; texts without a line of words, and null texts, get the share of good documents in the sample.

    A column of this name is replaced, others pass through; an empty table gives an empty one.
    """
    docs = docs.drop("score")
    schema, at = StructType([*docs.schema.fields, StructField("score", DoubleType())]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, at)):
            l = lines(b.column(at))  # noqa: E741
            p, _, _ = marginals(l.x.astype(float) @ model.node, model.edge, l.first)
            good, every = (np.concatenate([[0.0], np.cumsum(v)])[l.first] for v in (p * l.weight, l.weight))
            all_ = np.diff(every)
            score = np.where(all_ > 0, np.diff(good) / np.maximum(all_, 1e-9), model.prior)
            yield pa.record_batch([*b.columns, pa.array(np.clip(score, 0, 1))], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
