"""Language identification as inference of a multilingual mixture.

A language is a distribution over hashed byte trigrams of words, learned from labelled documents. A
document is a mixture: each of its words is in one language, and expectation-maximisation estimates
the languages' proportions from the words' trigram likelihoods. Starting from all languages, the
least likely one is dropped while the penalised likelihood (half the logarithm of the number of
words for each free proportion) does not fall. All documents of a slice iterate together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from courtlake.llm import words as W

CELLS = 1 << 15
UNKNOWN = "und"


def fold_of(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def trigrams(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all trigrams of the words, each word between two marks, and those before each word (one more than words)."""
    size = w.end - w.start
    before = np.concatenate([[0], np.cumsum(size)])  # a word of n bytes with its marks has n trigrams
    at = np.arange(before[-1]) + np.repeat(w.start - before[:-1], size)
    byte = W.LOWER[w.data].astype(np.uint32)
    mid = byte[at]
    left, right = byte[np.maximum(at - 1, 0)], byte[np.minimum(at + 1, len(byte) - 1)] if len(byte) else byte
    left[before[:-1]] = 0
    right[before[1:] - 1] = 0
    code = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), before


class Model(NamedTuple):
    langs: list[str]
    log_p: np.ndarray  # CELLS x languages, float32


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = 600, smoothing: float = 0.5) -> Model:
    """Trigram distributions from about ``sample`` distinct texts of each language (those of small hashes), whole texts, each once
    however many rows have it; from all where a language has fewer.

    Rows without a language teach nothing. The counts that reach the driver are ``CELLS`` per language at most.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    count = rows.groupBy("lang").agg(F.count_distinct("hash").alias("n")).collect()  # a row per language
    if not count:
        return Model([], np.zeros((CELLS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in count for x in (r.lang, min(1 << 30, (sample << 30) // r.n))])
    chosen = rows.where(F.pmod("hash", F.lit(1 << 30)) < share[F.col("lang")])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each text in the partition, so that copies are not dealt out; what it remembers is bounded by the sample."""
        seen = set()
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if new:
                yield b.take(pa.array(new))

    chosen = chosen.mapInArrow(once, "lang string, hash long, text string").dropDuplicates(["lang", "hash"]).select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            w = W.split(b.column(1))
            cell, before = trigrams(w)
            text = np.repeat(w.text_of, np.diff(before))
            for name in sorted(set(names)):
                n = np.bincount(cell[(names == name)[text]], minlength=CELLS)
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "cell", "n"])

    got = chosen.mapInArrow(tally, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((CELLS, len(langs)))
    for r in got:
        counts[r.cell, langs.index(r.lang)] = r.n
    total = counts.sum(axis=0, keepdims=True)
    return Model(langs, np.log((counts + smoothing) / (total + smoothing * CELLS)).astype(np.float32))


def _iterate(like: np.ndarray, first: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``steps`` of expectation-maximisation, and the documents' log-likelihoods under them."""
    size = np.diff(np.append(first, len(like)))
    for step in range(steps + 1):
        joint = like * np.repeat(pi, size, axis=0)
        total = np.maximum(joint.sum(axis=1), 1e-30)
        if step < steps:
            pi = np.add.reduceat(joint / total[:, None], first, axis=0) / size[:, None]
    return pi, np.add.reduceat(np.log(total), first).astype(float)


def mixtures(model: Model, w: W.Words, steps: int = 8, short_steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(all-language proportions, proportions over the chosen set) per text; rows of texts without words are zero."""
    texts, k = len(w.first) - 1, len(model.langs)
    full, chosen = np.zeros((texts, k)), np.zeros((texts, k))
    has = np.flatnonzero(np.diff(w.first) > 0)
    if not len(has) or not k:
        return full, chosen
    cell, before = trigrams(w)
    log = np.add.reduceat(model.log_p[cell], before[:-1], axis=0)
    like = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -60)).astype(np.float32)
    size, first = np.diff(w.first)[has], w.first[has]
    pi, value = _iterate(like, first, np.full((len(has), k), 1 / k, dtype=np.float32), steps)
    full[has] = pi
    pi = pi.copy()
    live = np.arange(len(has))
    for _ in range(k - 1):
        if not len(live):
            break
        trial = np.where(pi[live] > 0, pi[live], np.inf)
        weakest = trial.argmin(axis=1)
        trial = pi[live].copy()
        trial[np.arange(len(live)), weakest] = 0
        trial = np.where(trial > 0, np.maximum(trial, 1e-6), 0)
        trial /= trial.sum(axis=1, keepdims=True)
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first[live], size[live])]) if len(live) < len(has) else slice(None)
        begin = np.cumsum(size[live]) - size[live]
        new, worth = _iterate(like[rows], begin, trial.astype(np.float32), short_steps)
        better = worth - value[live] + 0.5 * np.log(np.maximum(size[live], 2)) >= 0
        pi[live[better]], value[live[better]] = new[better], worth[better]
        live = live[better]
        live = live[(pi[live] > 0).sum(axis=1) > 1]
    chosen[has] = pi
    return full, chosen


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``proportions``.

    ``lang_pred`` is the language of the largest proportion in the chosen set, ``score`` its proportion among all
    languages. ``und`` and 0 for a null text, one without a letter, or a model of no language; then
    ``proportions`` is empty. Columns of these names are replaced, others pass through; an empty table gives an empty one.
    """
    docs = docs.drop("lang_pred", "score", "proportions").withColumn("__letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    rest = docs.columns[:-1]
    schema = StructType([*docs.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("proportions", MapType(StringType(), DoubleType()))])
    at, names = rest.index(text), np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, at)):
            full, chosen = mixtures(model, W.split(b.column(at)))
            known = b.column(len(rest)).to_numpy(zero_copy_only=False).astype(bool) & (chosen.sum(axis=1) > 0 if len(model.langs) else False)
            best = chosen.argmax(axis=1) if len(model.langs) else np.zeros(b.num_rows, int)
            score = np.where(known, full[np.arange(b.num_rows), best] if len(model.langs) else 0.0, 0.0)
            found = [[(n, float(p)) for n, p in zip(model.langs, row) if p > 0] if yes else [] for row, yes in zip(chosen, known)]
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(names[np.where(known, best, len(model.langs))], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(found, pa.map_(pa.string(), pa.float64()))],
                [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
