"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: target, negation, report, and terms (insult, slur, threat). Small transducers rewrite them one after the other:
negation marks the terms in its scope as denied, a verb of saying marks those behind it as told, a target near a term marks it as aimed at
someone, and the last one keeps a clause's heaviest term. They are composed into one machine, which reads a clause once and ends in its
pattern, such as ``insult aimed`` or ``threat denied``; a clause without a term has none. A document's score is the logistic function
of the weights of its patterns, each by the logarithm of its clauses, and of its density of slurs.

Insults (words) and slurs (stems that count by their inflected forms, and mostly in company) are learned from labelled documents by
sequential covering; pattern weights are fitted to the same documents, drawn towards ``PRIOR``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

from courtlake.llm import words as W

# Function words, verbs of saying and of harm, and usual insults, in English, German, French and Spanish.
TARGET = set(
    "you your yours yourself he she they them him her u people du dich dir dein deine ihr euch euer sie toi tu te ton vous votre vos ils elles usted ustedes tú ti vosotros ellos ellas".split()
)
NEGATION = set("not no never nobody isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás".split())
REPORT = set("said says wrote told called calls quoted claimed alleged sagte sagt schrieb nannte nennt behauptet disait écrit appelé traité prétend dijo dice escribió llamó llama afirma".split())
THREAT = set("kill murder hurt destroy beat burn shoot stab töten umbringen verletzen verprügeln tuer frapper détruire brûler matar golpear destruir quemar".split())
INSULTS = set("idiot moron loser scum stupid pathetic worthless dumb dummkopf idioten trottel versager abschaum imbécile crétin connard débile idiota imbécil estúpido tonto basura".split())

KINDS, WAYS = ("insult", "slur", "threat"), ("plain", "aimed", "denied", "told")
PATTERNS = [f"{k} {w}" for k in KINDS for w in WAYS]
#: Log-odds to which the fitted weights are drawn; the heaviest of a clause's terms by them is its pattern.
PRIOR = dict(zip(PATTERNS, [5.0, 6.0, 1.5, 1.0, 2.0, 2.5, 0.8, 0.5, 1.0, 5.0, 0.3, 0.2]))
SCOPE, REACH = 3, 4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:|\n]")


class Transducer(NamedTuple):
    """Deterministic, letter to letter: (state, symbol) -> (state, symbol). A pair that is missing keeps the state and the symbol."""

    start: object
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(a: Transducer, b: Transducer, alphabet: list[str]) -> Transducer:
    """What ``b`` makes of ``a``'s output, as one machine over the pairs of states that can be reached."""
    start, arcs = (a.start, b.start), {}
    todo, seen = [start], {start}
    while todo:
        p, q = todo.pop()
        for symbol in alphabet:
            p2, middle = a.step(p, symbol)
            q2, out = b.step(q, middle)
            arcs[(p, q), symbol] = ((p2, q2), out)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return Transducer(start, arcs)


def negation(scope: int = SCOPE) -> Transducer:
    arcs = {}
    for k in range(scope + 1):
        for s in ("other", "target", "report"):
            arcs[k, s] = (max(k - 1, 0), s)
        arcs[k, "negation"] = (scope, "other")
        for t in KINDS:
            arcs[k, t] = (max(k - 1, 0), f"{t} denied" if k else t)
    return Transducer(0, arcs)


def reported() -> Transducer:
    arcs = {(k, "report"): (1, "other") for k in (0, 1)}
    return Transducer(0, arcs | {(1, t): (1, f"{t} told") for t in KINDS})


def targeted(reach: int = REACH) -> Transducer:
    """A term within ``reach`` words behind a target is aimed; so is the last term if a target is one of the two words behind it."""
    arcs = {}
    marked = [f"{t} {w}" for t in KINDS for w in ("denied", "told")]
    for k in range(reach + 1):
        for m in range(3):
            rest = (max(k - 1, 0), max(m - 1, 0))
            arcs[(k, m), "other"] = (rest, "other")
            arcs[(k, m), "target"] = ((reach, 0), "aim" if m else "other")
            for s in marked:
                arcs[(k, m), s] = (rest, s)
            for t in KINDS:
                arcs[(k, m), t] = ((rest[0], 2), f"{t} aimed" if k else f"{t} plain")
    return Transducer((0, 0), arcs)


def heaviest() -> Transducer:
    arcs = {}
    for have in ("", *PATTERNS):
        for s in PATTERNS:
            arcs[have, s] = (s if not have or PRIOR[s] > PRIOR[have] else have, s)
        if have.endswith("plain"):
            arcs[have, "aim"] = (have.replace("plain", "aimed"), "aim")
    return Transducer("", arcs)


def machine() -> tuple[dict[str, list[int]], list[str]]:
    """Per symbol, the state that follows each state (the start is 0), and each state's pattern."""
    alphabet = ["other", "target", "negation", "report", *KINDS]
    whole = negation()
    for t in (reported(), targeted(), heaviest()):
        whole = compose(whole, t, alphabet)
    states = {whole.start: 0}
    for (p, _), (q, _) in whole.arcs.items():
        states.setdefault(p, len(states))
        states.setdefault(q, len(states))
    table = {s: [0] * len(states) for s in alphabet}
    for (p, s), (q, _) in whole.arcs.items():
        table[s][states[p]] = states[q]
    return table, [p[1] for p in states]


class Term(NamedTuple):
    text: str
    stem: bool  # counts in longer words only
    kind: str


class Grammar:
    """Reads texts: how many clauses of each pattern, and how many words."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.exact = {t.text: t.kind for t in terms if not t.stem}
        self.stems = {t.text: t.kind for t in terms if t.stem}
        self.table, self.final = machine()
        words = sorted(self.exact, key=len, reverse=True) + sorted(self.stems, key=len, reverse=True)
        self.any = re.compile("|".join(map(re.escape, words))) if words else re.compile(r"(?!)")

    def symbol(self, word: str) -> str:
        if word in self.exact:
            return self.exact[word]
        for k in range(len(word) - 1, 2, -1):
            if word[:k] in self.stems:
                return self.stems[word[:k]]
        return "target" if word in TARGET else "negation" if word in NEGATION else "report" if word in REPORT else "other"

    def clause(self, text: str) -> str:
        """The pattern of a lower-case clause, '' for none."""
        state = 0
        for w in _WORD.findall(text):
            state = self.table[self.symbol(w)][state]
        return self.final[state]

    def read(self, text: str | None) -> tuple[Counter, int]:
        """Only clauses that hold a term's letters are run: in others no term can be, so they end without a pattern."""
        text = (text or "").lower()
        out: Counter = Counter()
        done = 0
        for m in self.any.finditer(text):
            if m.start() < done:
                continue
            lo = max((text.rfind(c, done, m.start()) for c in ".!?;:|\n"), default=-1)
            end = _CLAUSE_END.search(text, m.end())
            hi = end.start() if end else len(text)
            pattern = self.clause(text[max(lo + 1, done) : hi])
            if pattern:
                out[pattern] += 1
            done = hi
        return out, text.count(" ") + text.count("\n") + 1


class Model(NamedTuple):
    terms: list[Term]
    weights: list[float]  # of the patterns, of the density of slurs, and a constant


def row(counts: Counter, n_words: int) -> list[float]:
    """What is weighed. Stems also turn up by chance, the more the longer a text is, so slurs count by their share of the words as well."""
    slurs = sum(counts[f"slur {w}"] for w in WAYS)
    return [math.log2(1 + counts[p]) for p in PATTERNS] + [math.log2(1 + 100 * slurs / n_words), 1.0]


def _marks(text: str, least: int = 4, most: int = 40) -> Counter:
    """How often each word occurs, and each beginning of longer words (written with a hyphen)."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        if len(w) <= most:
            out[w] += n
            for k in range(least, len(w)):
                out[w[:k] + "-"] += n
    return out


def candidates(rows: DataFrame, least: int, most: int) -> list[str]:
    """The words and stems that tell toxic documents best: at most ``most``, each in ``least`` of them or more. ``rows``: label, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, 1)):
            seen: dict[str, list[int]] = {}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for m, n in _marks(t or "").items():
                    c = seen.setdefault(m, [0, 0, 0, 0])
                    c[2 * y] += 1
                    c[2 * y + 1] += n > 1
            yield pa.record_batch([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))], ["mark", "q1", "q2", "p1", "p2"])

    found = rows.select("label", "text").mapInArrow(count, "mark string, q1 long, q2 long, p1 long, p2 long")
    found = found.groupBy("mark").agg(*[F.sum(c).alias(c) for c in ("q1", "q2", "p1", "p2")]).where(F.col("p1") >= least)
    gain = F.greatest(*[F.col(f"p{k}") * F.log2((F.col(f"p{k}") + 0.5) / (F.col(f"p{k}") + F.col(f"q{k}") + 1) * 8) for k in (1, 2)])
    return [r.mark for r in found.orderBy(gain.desc(), F.length("mark"), "mark").limit(most).collect()]


def cover(docs: list[tuple[int, dict[str, int]]], least: int, precision: float, bits: float = 30.0) -> list[Term]:
    """Takes the mark of the largest gain over the toxic documents not yet covered, as a word or stem that tells alone (insult) or in company
    (slur: two or more), until none covers ``least`` of them at that precision; then every other one that tells as much by itself as ``bits``,
    though others cover its documents. Ties go to the longer mark. Beginnings and longer forms of a stem taken go with it."""
    terms: list[Term] = []

    def best(live: list, floor: float) -> tuple[str, int] | None:
        p, q = Counter(), Counter()
        for y, marks in live:
            for m, n in marks.items():
                for k in (1, 2) if n > 1 else (1,):
                    (p if y else q)[m, k] += 1
        positive, top = sum(y for y, _ in live), (floor, 0, "", 0)
        for (m, k), n in p.items():
            sure = (n + 0.5) / (n + q[m, k] + 1)
            if n >= least and sure >= precision and not taken(m):
                top = max(top, (n * math.log2(sure * len(live) / positive), len(m), m, k))
        return top[2:] if top[3] else None

    def taken(mark: str) -> bool:
        own = mark.rstrip("-")
        return any(own == t.text or (t.stem and own.startswith(t.text)) or (mark != own and t.text.startswith(own)) for t in terms)

    live = docs
    while found := best(live, 0.0):
        m, k = found
        terms.append(Term(m.rstrip("-"), m.endswith("-"), "insult" if k == 1 and not m.endswith("-") else "slur"))
        live = [d for d in live if d[1].get(m, 0) < k]
    while found := best(docs, bits):
        m, k = found
        terms.append(Term(m.rstrip("-"), m.endswith("-"), "insult" if k == 1 and not m.endswith("-") else "slur"))
    return terms


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> list[float]:
    """Newton steps of a logistic regression drawn towards ``PRIOR``; the constant towards -4."""
    prior = np.array([*(PRIOR[p] for p in PATTERNS), 1.0, -4.0])
    w = prior.copy()
    pull = np.full(len(w), ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000, least: int = 4, precision: float = 0.75, most: int = 1500) -> Model:
    """A model from at most ``sample`` labelled documents, those of the smallest hashes of their ids, equal texts once. Null labels, ids
    and texts teach nothing; without labelled rows the usual insults and ``PRIOR`` stay."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(F.broadcast(ids), "__id")
    rows = rows.groupBy(F.sha2("text", 256).alias("__h")).agg(F.max("label").alias("label"), F.min("text").alias("text"))
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__h").persist()
    try:
        known = candidates(rows, least, most)
        wanted = set(known)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for batch in batches for x in W.slices(batch, 1)):
                found = [[(m, n) for m, n in _marks(t or "").items() if m in wanted] for t in b.column(1).to_pylist()]
                yield pa.record_batch([b.column(0), pa.array([[m for m, _ in f] for f in found], pa.list_(pa.string())), pa.array([[min(n, 2) for _, n in f] for f in found], pa.list_(pa.int32()))], ["label", "marks", "times"])

        seen = rows.select("label", "text").mapInArrow(count, "label int, marks array<string>, times array<int>").collect()
        seen = sorted((r.label, sorted(zip(r.marks, r.times))) for r in seen)
        terms = cover([(y, dict(m)) for y, m in seen], least, precision)
        have = {t.text for t in terms}
        terms += [Term(w, False, "insult") for w in sorted(INSULTS - have)] + [Term(w, False, "threat") for w in sorted(THREAT - have)]
        grammar = Grammar(terms)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for batch in batches for x in W.slices(batch, 1)):
                yield pa.record_batch([b.column(0), pa.array([row(*grammar.read(t)) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

        values = sorted((r.label, r.x) for r in rows.select("label", "text").mapInArrow(read, "label int, x array<double>").collect())
    finally:
        rows.unpersist()
    x = np.array([v for _, v in values], dtype=float).reshape(-1, len(PATTERNS) + 2)
    return Model(terms, fit(x, np.array([y for y, _ in values], dtype=float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score", patterns: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1) and, if named, ``patterns``: clauses by pattern.

    The whole text is read. Null and empty texts have no clause and get the score of that. Columns of these names are replaced, others pass
    through; rows are scored each on its own, so repeated ones agree; an empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in (score, patterns) if c and c != text])
    rest = [f for f in docs.schema.fields if f.name != text]
    extra = [StructField(score, DoubleType())]
    out = StructType([*rest, *extra])
    if patterns:
        out = out.add(patterns, MapType(StringType(), IntegerType()))
    grammar, w, at = Grammar(model.terms), model.weights, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, at)):
            read = [grammar.read(t) for t in b.column(at).to_pylist()]
            z = [sum(u * v for u, v in zip(w, row(*r))) for r in read]
            columns = [*(b.select([f.name for f in rest]).columns if rest else []), pa.array([1 / (1 + math.exp(-max(min(v, 30), -30))) for v in z], pa.float64())]
            if patterns:
                columns.append(pa.array([list(c.items()) for c, _ in read], pa.map_(pa.string(), pa.int32())))
            yield pa.record_batch(columns, [f.name for f in out.fields])

    return docs.mapInArrow(run, out)
