"""Toxicity, alignment of tokenizers and spelling variants on small tables, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from courtlake.llm import alignment as AL, spelling as SP, toxicity as T
from courtlake.llm.queries import tokenizer_file

DOC = "doc_id long, text string, n long, place int, known string, label int, word string"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def docs_of(spark, rows, parts=3):
    """Columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 0, "w") for i, t in rows], DOC).repartition(parts)


# -- alignment ------------------------------------------------------------------
ODD = [
    None, "", " ", "a", " lead", "two  spaces", "a▁b", "<|endoftext|> <s> </s> [INST]", "é\xa0 b　 c  \n d", "tab\t x \x1c y", "日本 語 🙂 a\x85 b", "'s 're it's  ",
    "\x00 a", "one two three", "one two three", "W" * 300 + " " + "ab" * 400, "ünïcödé wörds — “quoted” … end.\n\nNew line", "trail  ",
]


def plain_alignment(rows):
    """Per document by token ends and sets, pair counts over all of them."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    va, vb = AL.byte_level(A), AL.piece_level(B)
    piece = lambda v, i: v.data[v.start[i] : v.start[i + 1]].tobytes()
    found, count = [], collections.Counter()
    for i, text in rows:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        if any(b"".join(piece(v, k) for k in x) != (" " + text).encode() for v, x in ((va, a), (vb, b)) if text):
            a, b = [], []
        spans = []
        for v, x in ((va, a), (vb, b)):
            ends = list(itertools.accumulate(len(piece(v, k)) for k in x))
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (p, q) in zip(b, spans[1]) if max(s, p) < min(e, q)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(k) for k, (s, _) in zip(x, sp) if lo <= s < hi) for x, sp in ((a, spans[0]), (b, spans[1]))))
        count.update(links)
        found.append((i, a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        (i, len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, links in found
    )


@pytest.mark.parametrize("chunk_bytes", [4_000_000, 200])
def test_alignment_against_brute_force(spark, chunk_bytes):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "Alignment", "naïve", "x.\nY", "tokenizers,", "(12345)", "don't", "straße"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "the same id"), (3, "the same id")]
    got = AL.cross_tokenizer_alignment(docs_of(spark, rows), A, B, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect())) == plain_alignment(rows)


def test_alignment_of_nothing(spark):
    assert AL.cross_tokenizer_alignment(docs_of(spark, [], 1), A, B).collect() == []
    got = AL.cross_tokenizer_alignment(docs_of(spark, [(None, None), (None, "a b")]), A, B).collect()
    assert sorted((r.doc_id, r.n_a, r.groups_sha256 == "") for r in got) == [(None, 0, True), (None, 2, False)]


def test_alignment_cache_is_bounded_and_texts_are_whole(spark):
    small = AL.Cached(AL.byte_level(A), most=5), AL.Cached(AL.piece_level(B), most=5)
    texts = pa.array([f"word{i} other{i} " * 20 for i in range(30)] + ["long text " * 40_000])
    got, want = AL.align(texts, *small), AL.align(texts, AL.Cached(AL.byte_level(A)), AL.Cached(AL.piece_level(B)))
    again = AL.align(texts, *small)
    for x, y, z in zip(got[:4], want[:4], again[:4]):
        assert (x == y).all() and (x == z).all()
    # Common bounds of the long text, without the merge.
    a, b = got.at_a[-2], got.at_b[-2]
    v = [np.cumsum(c.v.length[i]) for c, i in zip(small, (got.ids_a[a:], got.ids_b[b:]))]
    assert got.merged.cut_a[a:].sum() == len(np.intersect1d(*v))


# -- spelling -------------------------------------------------------------------
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(rows, every):
    n = collections.Counter()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    form, count = {}, {}
    for w in n:
        around = sorted((-n[v], v) for v in n if near(v, w))
        count[w] = len(around)
        form[w] = around[0][1] if around and -around[0][0] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n), key=str)


@pytest.mark.parametrize("cell, leaf, tile, every", [(20_000, 24, 100_000, 97), (12, 2, 7, 5)])
def test_spelling_against_brute_force(spark, monkeypatch, cell, leaf, tile, every):
    rng = random.Random(5)
    base = ["colour", "harbour", "neighbour", "élection", "Straßen", "aaaaaaa", "ababab", "bababa", "À×÷ÿabc", "thereing", "ingthere"]
    words = list(base)
    for _ in range(4):
        for w in base:
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words[: rng.choice([11, 40, 143])]) + rng.choice([",", "", "1", "\n"]) for _ in range(120))))
    rows += [(None, "colour colour color"), (1, None), (2, ""), rows[0], (7, "aaaaaaaa " * 2000)]
    original = SP.near_words
    monkeypatch.setattr(SP, "near_words", lambda w: original(w, cell=cell, leaf=leaf, tile=tile))
    got = SP.spelling_variants(docs_of(spark, rows), every=every).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_spelling(rows, every)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[2] != r[1] and r[1] for r in want)


def test_spelling_of_nothing(spark):
    assert SP.spelling_variants(docs_of(spark, [], 1)).collect() == []
    assert SP.spelling_variants(docs_of(spark, [(1, None), (2, "a b 12 ; ab")])).collect() == []


def test_words_of_unseen_lengths_and_equal_counts():
    """Every pair one edit apart is reached: a tree fitted on other words, anagrams that no split can part."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(600)] + ["abcabc"[k:] + "abcabc"[:k] for k in range(6)]
    _, _, x = SP.points(words)
    for tree in (SP.grow(x[:100], 5, False), SP.grow(x, 5, True)):
        home = tree.leaf_of(x)
        row, leaf = tree.reached(x, np.full(len(x), 2))
        at = collections.defaultdict(set)
        for r, k in zip(row.tolist(), leaf.tolist()):
            at[r].add(k)
        for i, j in itertools.combinations(range(len(words)), 2):
            if near(words[i], words[j]):
                assert home[j] in at[i] and home[i] in at[j]


# -- toxicity -------------------------------------------------------------------
TERMS = [T.Term("moron", False, "insult"), T.Term("gruml", True, "slur"), T.Term("kill", False, "threat")]


@pytest.mark.parametrize("clause, pattern", [
    ("what a fine day", ""), ("a moron came", "insult plain"), ("you are a moron", "insult aimed"), ("moron that came for you", "insult plain"), ("moron that you are", "insult aimed"), ("moron you are", "insult aimed"),
    ("you are not a moron", "insult denied"), ("he said that you are a moron", "insult told"), ("they never called you a moron", "insult told"),
    ("no one here likes rain but a moron", "insult plain"), ("i will kill you", "threat aimed"), ("kill the light", "threat plain"), ("gruml", ""), ("grumling gruml", "slur plain"),
    ("grumlek and a moron", "insult plain"), ("you and you and you and so on and on moron", "insult plain"), ("oxymorons morons", ""),
])
def test_patterns_of_clauses(clause, pattern):
    assert T.Grammar(TERMS).clause(clause) == pattern


def test_machine_equals_its_parts_in_turn():
    alphabet = ["other", "target", "negation", "report", *T.KINDS]
    table, final = T.machine()
    rng = random.Random(2)
    for _ in range(500):
        symbols = [rng.choice(alphabet) for _ in range(rng.randrange(12))]
        out = symbols
        for t in (T.negation(), T.reported(), T.targeted(), T.heaviest()):
            state, made = t.start, []
            for s in out:
                state, s = t.step(state, s)
                made.append(s)
            out = made
        k = 0
        for s in symbols:
            k = table[s][k]
        assert final[k] == state


def test_reading_whole_texts_equals_reading_all_clauses():
    rng = random.Random(4)
    words = ["you", "moron", "Grumling", "gruml", "not", "said", "rain", "Kill", "xmoron", "moronx", "day"]
    g = T.Grammar(TERMS)
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ". ", "\n", "! "]) for _ in range(rng.randrange(40)))
        want = collections.Counter(p for p in (g.clause(c) for c in re.split(r"[.!?;:|\n]", text.lower())) if p)
        assert g.read(text)[0] == want
    assert g.read(None)[0] == g.read("")[0] == {}


def test_learning_and_scores(spark):
    rng = random.Random(6)
    plain = ["rain", "day", "house", "grumlos", "market", "river", "not", "said", "you"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["blorb", "zwik" + rng.choice(["en", "er", "ung", "lich"])])
        elif i % 7 == 0:
            w[3] = "zwik"
        rows.append((i, ". ".join(" ".join(w[k : k + 6]) for k in range(0, 60, 6))))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "BLORB! " * 3), (1003, "blorb " * 200_000), (1003, "rain"), (None, "you blorb")]
    table = spark.createDataFrame(labels + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    model = T.learn(docs, table)
    assert {("blorb", False), ("zwik", True)} <= {(t.text, t.stem) for t in model.terms}
    got = T.score_toxicity(docs.withColumnRenamed("n", "score"), model, patterns="patterns").collect()
    assert len(got) == len(rows) and "text" not in got[0]
    by = {r.doc_id: r.score for r in got if r.doc_id != 1003}
    assert sum((by[i] >= 0.5) != bool(t) for i, _, t in labels) <= 3
    assert by[1000] == by[1001] < 0.5 < by[1002] and by[None] > 0.5
    assert sorted(r.score > 0.5 for r in got if r.doc_id == 1003) == [False, True]
    assert T.learn(docs, table) == model


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.learn(docs_of(spark, [(1, "you idiot")]), none)
    got = T.score_toxicity(docs_of(spark, [(1, "you idiot"), (2, "a good day")], 1), model).orderBy("doc_id").collect()
    assert got[0].score > 0.5 > got[1].score
    assert T.score_toxicity(docs_of(spark, [], 1), model).collect() == []
