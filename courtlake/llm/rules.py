"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering, run as one Spark expression.

Statistics of whole texts are built-in column functions. Labelled statistics (a bounded sample)
teach the list on the driver: rules for the bad class grow condition by condition by information
gain on two thirds of the rows, are pruned on the other third, and are kept while they stay
precise there; covered rows leave before the next rule grows. The list becomes
``CASE WHEN rule THEN false ... ELSE true END``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"\x20\x09-\x0D"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test, as SQL over the statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "again": "n_again / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def repeat_words(words: str, window: int) -> str:
    """SQL: how many of the words lie in a run of ``window`` words that occurs twice or more in the array.

    Hashes of runs are doubled up from hashes of words. Only if two are equal are they sorted, with
    their places, and the places of equal neighbours merged; ``transform(array(x), y -> ...)[0]`` binds x once.
    """
    runs = f"transform({words}, w -> xxhash64(w))"
    width = 1
    while width < window:
        step = min(width, window - width)
        runs = f"transform(array({runs}), h -> zip_with(slice(h, 1, greatest(size(h) - {step}, 0)), slice(h, {step + 1}, greatest(size(h) - {step}, 0)), (a, b) -> xxhash64(a, b)))[0]"
        width += step
    same = "filter(s, (x, i) -> x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h)"
    places = f"transform(array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))), s -> array_sort(transform({same}, x -> x.i)))[0]"
    covered = f"transform(array({places}), p -> aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({window}, coalesce(b - a, {window}))), 0, (n, x) -> n + x))[0]"
    return f"CAST(CASE WHEN size({words}) <= {window} THEN 0 ELSE transform(array({runs}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {covered} END)[0] END AS BIGINT)"


def words_again(words: str) -> str:
    """SQL: how many of the words equal the word before them; ``get(words, i - 1)`` would split the text again for each word."""
    return f"transform(array({words}), w -> size(filter(zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, size(w)), (a, b) -> a = b), x -> x)))[0]"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``__s`` of a text's statistics; a null text has none of anything.

    The struct is exploded from an array of it alone: a filter or projection over what is generated is never moved below, where
    it would split the text again for each use.
    """
    t, words, lines = "__t", "__words", "__lines"
    count = lambda chars: F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]", ""))
    out = docs.withColumn(t, F.coalesce(text, F.lit("")))
    out = out.withColumns({
        words: F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != ""),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    stats = {
        "n_words": F.size(words), "word_chars": F.length(F.regexp_replace(t, f"[{SPACE}]+", "")), "n_symbols": count("#*$%&|<>"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": F.expr(repeat_words(words, 8)),
        "n_lines": F.size(lines), "n_upper": count("A-Z"), "n_marks": count("!?"),
        "n_again": F.expr(words_again(words)),
    }
    s = F.struct(*[c.cast("long").alias(n) for n, c in stats.items()])
    return out.select("*", F.explode(F.array(s)).alias("__s")).drop(t, words, lines)


def base_failed() -> Column:
    return (F.col("__s.n_words") < 20) | (100 * F.col("__s.n_repeat_words") > 30 * F.col("__s.n_words"))


class Condition(NamedTuple):
    feature: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.value if self.above else x <= self.value

    def column(self, stats: str) -> Column:
        x = F.expr(FEATURES[self.feature].replace("n_", f"{stats}.n_").replace("word_chars", f"{stats}.word_chars"))
        return x > self.value if self.above else x <= self.value


Rule = list[Condition]


def _holds(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, cuts: int, most: int) -> Rule:
    """Adds the condition of the largest FOIL gain until no good row is covered or none gains; thresholds lie halfway between neighbours."""
    rule: Rule = []
    inside = live.copy()
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (0.0, None)
        for name, x in table.items():
            values = np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, cuts)))
            order = np.sort(x[inside])
            for v in values:
                for above in (False, True):
                    at = np.searchsorted(order, v, side="left" if above else "right")
                    if not 0 < at < len(order):
                        continue  # all rows hold
                    value = (order[at - 1] + order[at]) / 2
                    hit = inside & (x > value if above else x <= value)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(name, above, float(value)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(table)
    return rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least_covered: int = 3, cuts: int = 24, most_conditions: int = 4, most_rules: int = 12) -> list[Rule]:
    """The decision list; rows alternate between growing (two of three) and pruning. No bad or no good rows: no rule."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    live, rules = np.ones(n, dtype=bool), []
    while len(rules) < most_rules and (live & bad & ~prune).any() and (~bad).any():
        rule = _grow(table, bad, live & ~prune, cuts, most_conditions)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _holds(rule[:k], table, n) & live
            p, q = (hit & prune & bad).sum(), (hit & prune & ~bad).sum()
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        hit = _holds(rule, table, n) & live
        good, all_ = (hit & ~bad).sum(), hit.sum()
        if all_ - good < least_covered or (all_ - good) < precision * all_ or max(worth)[0] < 2 * precision - 1:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 8000) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents, those of the smallest hashes of their ids, without those that fail
    the base rules; null labels teach nothing."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__bad"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id", "__bad").limit(sample)
    rows = statistics(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id"), "__text")
    rows = rows.select("__id", "__bad", base_failed().alias("failed"), *[F.expr(e.replace("n_", "__s.n_").replace("word_chars", "__s.word_chars")).cast("double").alias(f) for f, e in FEATURES.items()])
    # Failed rows go here, not in a filter: that would be pushed below the join and compute all documents' statistics.
    rows = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("__id"), "__id").limit(sample).collect() if not r.failed)
    if not rows:
        return []
    values = np.array([r[1:] for r in rows], dtype=float)
    return learn({f: values[:, 2 + i] for i, f in enumerate(FEATURES)}, values[:, 0] == 0)


def verdict(rules: list[Rule], stats: str = "__s") -> Column:
    """False for what a rule covers, by the first that does, else true."""
    out = None
    for rule in rules:
        cond = rule[0].column(stats)
        for c in rule[1:]:
            cond = cond & c.column(stats)
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``kept``; columns of these names are replaced.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows (so empty and
    null texts fail). ``kept``: false if so, else the list's verdict. One row per row; no shuffle.
    """
    out = statistics(docs.drop(*BASE, "base_failed", "kept"), text)
    out = out.withColumns({c: F.col(f"__s.{c}") for c in BASE} | {"base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop("__s")
