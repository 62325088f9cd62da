"""Main text of web pages: flat text blocks, classified by a decision tree over shallow text features.

A page is cut into flat blocks at block-level tags. Each block is described by its word count and
link density, those of its neighbours, and what its place says: inside an article or main element, in a
heading, or inside a container whose tag, class, id or role names page furniture. The tree is grown
here, by Gini impurity, from the blocks of a few labelled pages (``LABELLED``), and classifies all
blocks of a batch at once.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from courtlake.llm import words as W

# Element names of the HTML standard and usual names of page furniture.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = set("applet audio button canvas iframe map math noscript object script select style svg template textarea title video".split())
RAW = {"script", "style", "textarea", "title"}  # hold no tags; without an end tag they go on to the page's end, as in browsers
FOREIGN = {"svg", "math"}
ENDS_SKIPPED = BLOCK - {"option"} | {"a"}
HTML_WITHIN = {"foreignobject", "desc", "annotation-xml"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option"}
FURNITURE_TAGS = set("aside dialog footer form header menu nav search".split())
FURNITURE = set(
    "ad ads adbox advert advertisement adverts advertising aside banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing shop sidebar signup social sponsor sponsored subscribe tags teaser toc toolbar "
    "topbar widget alert complementary contentinfo dialog".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# A quote opens a value only behind an equals sign; one that is never closed is like any other character.
_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S)
_CUT_OFF = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
_RAW_END |= {n: re.compile(rf"<(/?){n}(?=[\s/>])[^>]*>?", re.I) for n in ("iframe", "noscript")}  # cannot nest, so a second start says that the end is missing
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    furniture: int
    article: int
    heading: int


class Open(list):
    """The open elements, names first, and where those of each name are, so that none has to be looked for."""

    def __init__(self):
        super().__init__()
        self.at: dict[str, list[int]] = {}

    def push(self, *element) -> None:
        self.at.setdefault(element[0], []).append(len(self))
        self.append(element)

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, k: int) -> list[tuple]:
        """Takes the elements from place ``k`` on away, and returns them."""
        gone = self[k:]
        for e in gone:
            self.at[e[0]].pop()
        del self[k:]
        return gone


def _names_furniture(attributes: str) -> bool:
    return any(t.lower() in FURNITURE for m in _NAMES.finditer(attributes) for t in _TOKEN.findall(m[1] or m[2] or m[3] or ""))


def _tags(page: str) -> tuple[list[re.Match], dict[int, tuple[int, int]]]:
    """The page's tags and, for each that opens what is never shown, the tag and the place in the page to go on from.

    Scripts and their like end at their own end tag, whatever looks like a tag in them. Other skipped elements end at theirs too; where
    it is missing, at the next block-level tag or link, or at once if none follows. An end tag of a block around them, a second button or
    select, and a block inside a drawing or formula mean that it is missing."""
    out: list[re.Match] = []
    after: dict[int, tuple[int, int]] = {}
    open_ = Open()  # name, tag, whether drawing or formula
    lost: list[int] = []
    never: set[str] = set()
    pos, last = 0, page.rfind(">") + 1  # behind it no tag can end
    while m := _TAG.search(page, pos, last):
        pos, k, name = m.end(), len(out), (m[2] or "").lower()
        out.append(m)
        if pos == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
            after[k] = (k + 1, len(page))  # a comment without an end
            break
        if name not in BLOCK and name not in SKIPPED and name not in HTML_WITHIN:
            continue
        foreign = bool(open_) and open_[-1][2]
        if m[1]:
            i = open_.last(name)
            if i >= 0 and (name in SKIPPED or i > open_.last("applet", "object", "template")):
                own, *within = open_.close(i)
                lost += [j for n, j, _ in within if n in SKIPPED]
                if name in SKIPPED:
                    after[own[1]] = (k + 1, pos)
            continue
        closed = m[3].rstrip().endswith("/")
        if name in _RAW_END and not foreign:
            if closed and name not in RAW:
                after[k] = (k + 1, pos)
                continue
            end = None if name in never else _RAW_END[name].search(page, pos)
            if not end:
                never.add(name)
            if end and (name in RAW or end[1]):
                pos = end.end()
            elif name in RAW:
                pos = len(page)
            else:
                lost.append(k)
                continue
            after[k] = (k + 1, pos)
        elif name in SKIPPED:
            if closed:
                after[k] = (k + 1, pos)
                continue
            if name in ("button", "select"):
                i = open_.last(name)
                if i >= 0:
                    lost += [j for n, j, _ in open_.close(i) if n in SKIPPED]
            open_.push(name, k, foreign or name in FOREIGN)
        elif name in HTML_WITHIN:
            if foreign and not closed:
                open_.push(name, k, False)
        elif name not in VOID:
            while open_ and open_[-1][2]:
                lost += [j for n, j, _ in open_.close(len(open_) - 1) if n in SKIPPED]
            open_.push(name, k, False)
    lost += [j for n, j, _ in open_ if n in SKIPPED]
    at = [k for k, m in enumerate(out) if (m[2] or "").lower() in ENDS_SKIPPED] if lost else []
    for j in lost:
        i = bisect_right(at, j)
        after[j] = (at[i], out[at[i]].start()) if i < len(at) else (j + 1, out[j].end())
    return out, after


class Container(NamedTuple):
    parent: int
    tag: bool  # an element for page furniture
    named: bool  # its class, id or role names page furniture
    article: int  # article and main elements up to here


def blocks(page: str) -> list[Block]:
    """The page's flat blocks in order; markup, comments and what is never shown are left out. Broken markup does not matter:
    an end tag without its start is ignored, one that is missing is implied by what follows, a tag cut off by the page's end goes.

    A container that is named like page furniture but holds most of the page's words is the page itself, whatever it is called.
    """
    found: list[tuple[str, int, int, int, int]] = []  # text, words, linked words, container, heading
    open_ = Open()  # name, container
    containers = [Container(-1, False, False, 0)]
    parts: list[tuple[str, bool]] = []
    link, at, heading = False, 0, 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, a in parts if a)
            found.append((text, text.count(" ") + 1, linked, open_[-1][1] if open_ else 0, heading))
        parts.clear()

    page = _CUT_OFF.sub("", page)
    tags, after = _tags(page)
    go_on = 0
    for k, m in enumerate(tags):
        if k < go_on:
            continue
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), link))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            go_on, at = after.get(k, (go_on, at))
            continue
        if m[1]:
            if name == "a":
                link = False
            k = open_.last(name)
            if name in BLOCK:
                flush()
                heading = 0
            if k >= 0:
                if name not in BLOCK:
                    flush()
                open_.close(k)
            continue
        if name in SKIPPED:
            if k in after:
                go_on, at = after[k]
            parts.append((" ", link))
            continue
        if name == "br" or name == "img":
            parts.append((" ", link))
        if name == "a":
            link = True
        named = bool(m[3]) and _names_furniture(m[3])
        if name in BLOCK:
            flush()
            heading = int(name in HEADINGS)
            if name in CLOSES_P and (k := open_.last("p")) >= 0:
                open_.close(k)
            if name == "li" and (k := open_.last("li", "ul", "ol")) >= 0 and open_[k][0] == "li":
                open_.close(k)
        if name not in VOID and (name in BLOCK or named):
            if named and name not in BLOCK:
                flush()
            inside = open_[-1][1] if open_ else 0
            article = containers[inside].article
            whole = name in ("body", "html", "article", "main")  # the whole page's class says nothing about a part of it
            furniture = name in FURNITURE_TAGS and not (name == "header" and article)
            if named and not whole or furniture or name in ("article", "main"):
                containers.append(Container(inside, furniture, named and not whole, article + (name in ("article", "main"))))
                inside = len(containers) - 1
            open_.push(name, inside)
    if at < len(page):
        parts.append((html.unescape(page[at:]), link))
    flush()

    held = [0] * len(containers)
    for _, words, _, c, _ in found:
        held[c] += words
    for c in range(len(containers) - 1, 0, -1):  # a container comes behind the one it is in
        held[containers[c].parent] += held[c]
    within = [False]
    for c in containers[1:]:
        within.append(within[c.parent] or c.tag or (c.named and 2 * held[len(within)] <= held[0]))
    return [Block(text, words, linked, int(within[c]), min(containers[c].article, 1), h) for text, words, linked, c, h in found]


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_behind", "link_density_behind", "furniture", "article", "heading"]


def features(found: list[list[Block]]) -> np.ndarray:
    """A row of ``FEATURES`` per block of all pages; a neighbour that does not exist has no words and no links."""
    flat = [b for page in found for b in page]
    own = np.array([(b.words, b.linked / b.words, b.furniture, b.article, b.heading) for b in flat], dtype=float).reshape(-1, 5)
    size = np.array([len(p) for p in found], dtype=int)
    first = np.cumsum(size) - size
    before, behind = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
    before[1:], behind[:-1] = own[:-1, :2], own[1:, :2]
    before[first[size > 0]], behind[(first + size - 1)[size > 0]] = 0, 0
    return np.column_stack([own[:, :2], before, behind, own[:, 2:]])


class Leaf(NamedTuple):
    keep: bool


class Split(NamedTuple):
    feature: int
    value: float
    low: Leaf | Split
    high: Leaf | Split


def grow(x: np.ndarray, y: np.ndarray, depth: int = 4, least: int = 2) -> Leaf | Split:
    """Splits by the largest fall in Gini impurity, halfway between neighbouring values; ties go to the first feature."""
    share = y.mean() if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Leaf(share > 0.5)
    best = (len(y) * share * (1 - share) - 1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        for k in np.flatnonzero(np.diff(v)) + 1:
            if least <= k <= len(y) - least:
                a, b = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(y) - k)
                impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if impurity < best[0] - 1e-12:
                    best = (impurity, (f, (v[k - 1] + v[k]) / 2))
    if best[1] is None:
        return Leaf(share > 0.5)
    f, value = best[1]
    low = x[:, f] <= value
    return Split(f, value, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.keep)
    low = x[:, tree.feature] <= tree.value
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = classify(tree.low, x[low]), classify(tree.high, x[~low])
    return out


# Small labelled pages: blocks that begin with + are main text.
LABELLED = [
    """<body><header><a href=/>Home</a> The daily</header><nav><ul><li><a href=/a>World</a><li><a href=/b>Sport and games</a></ul></nav>
    <article><h1>+ River reaches its highest mark</h1><p>+ The water rose all night and by the morning it stood at the edge of the old market, where people had put up walls of sand.
    <p>+ Nobody was hurt.<p>+ Read the <a href=/r>full report</a> of the council, which also lists the streets that stay closed until the weekend and the places where help is given.</article>
    <aside><h3>Most read</h3><ul><li><a href=/1>Ten ways to cook beans at home</a><li><a href=/2>Election results by district and party so far</a></ul></aside>
    <footer>Copyright of the daily. All rights are reserved and nothing may be copied without our written consent in advance.</footer></body>""",
    """<body><div class=menu><a href=1>Start</a> <a href=2>Shop</a> <a href=3>About us</a></div><div class="ad">Buy two lamps and pay for one until Sunday.</div>
    <div id=content><h2>+ A short history of lamps</h2><p>+ Lamps burned oil for thousands of years before gas came into the towns, and gas was in turn given up for the electric bulb.</p>
    <p>+ Short.</p><p>+ The first bulbs lasted some hours only; later ones burned for years, and a few from that time are still alight today in museums.</p></div>
    <div class="comments"><p>I had one of these when I was a child and it never once failed me in all those years, honestly.</p><p>Great text!</p></div>
    <div class=footer><p>Imprint</p></div></body>""",
    """<body><div class="cookie-notice">We use cookies to make this page better for you. <a href=/c>Settings</a></div>
    <nav><a href=1>News</a></nav><main><h1>+ Trains run late again</h1><p>+ For the third time in this month trains between the two towns ran late, some of them by more than an hour.</p><p>+ Why?</p>
    <div class="advert">The best shoes of the year, now at a lower price in our shop in the city.</div><p>+ A broken switch, says the company, and promises to replace all of that type before winter comes.</p>
    <ul><li><a href=7>More on trains</a></li><li><a href=8>More on towns and what goes on in them</a></li></ul><form><p>Write to us if you were in one of these trains and tell us your story in a few words.</p></form></main><footer>Contact</footer></body>""",
    """<body><table><tr><td><a href=a>One</a><td><a href=b>Two</a><td><a href=c>Three</a></tr></table><p>+ This page has no article element, yet its text is plain to see since
    the paragraphs are long and hold no links at all, as is usual for prose of any kind.</p><p>+ A second paragraph follows the first one here, nearly as long as the first and just as free of links.</p>
    <p><a href=n>Next page</a> <a href=p>Last page</a></p><div class="sidebar"><p>About the author: a writer of long sentences who lives by the sea with two cats and a dog.</p></div></body>""",
    """<body><div><a href=1>Log in</a></div><div><a href=2>Help</a></div><div><h1>+ Bread without yeast</h1></div><div>+ Mix flour, water and salt, let the dough rest for an hour under a cloth, then bake
    it in a very hot oven until the crust is brown.</div><div>+ Serve warm.</div><div>+ The dough keeps for two days in a cold place, and it may be frozen for later use as well without harm.</div>
    <div><a href=3>More recipes for bread and cakes</a></div><div><a href=4>Soups</a></div><div class="newsletter">Get a new recipe by letter each week, free of charge, for as long as you like.</div></body>""",
    """<body><div><a href=1>Rooms</a></div><div>Call us today</div><div><a href=2>Prices</a></div><div><a href=3>Way here</a></div><div>+ The house stands on a hill above the lake and
    has been run by the same family for four generations, in summer and in winter.</div><div>+ Dogs may stay.</div><div>+ Each room has a view of the water, and on clear days the mountains on the other shore
    are so near that one could count the trees on them.</div><div><a href=4>Book a room</a></div><div>Open all year</div><div><a href=5>Imprint</a></div><div>Made by hand</div><div><a href=6>Top</a></div></body>""",
    """<body><nav><ul><li><a href=1>It</a></li></ul></nav><div class=ad>Yes.</div><article><h1>+ Yes.</h1><p>+ No.</p></article><footer>It is.</footer></body>""",
    """<body><div class=ad>Now cheaper than ever.</div><p>+ Clay is dug in autumn and left outside through the winter, so that frost breaks it up and rain washes out the salt and the chalk that is in it.</p>
    <div class="promo box">Three for two.</div><p>+ In spring it is stirred with water, let through a sieve and dried in the sun until it can be cut with a wire into blocks of equal weight.</p>
    <div id=newsletter>Sign up here.</div><p>+ Only then does the potter take it to the wheel, where a morning is enough for forty cups or for a dozen of the large bowls.</p></body>""",
    """<body><div class=ad>A good pen writes by itself.</div><article><p>+ He who wishes to write must first learn to look, for there is more to be seen in one street than in ten books, said the old man, and went on to mend his net.</p></article>
    <div class=sponsored>Pens for all.</div><article><p>+ The net was green and had been mended so often that not one thread of the first was left in it, yet it was, he said, the net that his father had given to him.</p></article></body>""",
    """<body><article><h1>+ A talk</h1><p>+ You came.</p><p>+ Yes.</p><p>+ I waited for you at the gate until it was dark and the last of the carts had gone by on its way home.</p><p>+ Why?</p><p>+ So.</p>
    <p>+ Go on then and tell me what it is that you want of me, since you have come all this way.</p><p>+ Bread.</p><p>+ Bread?</p><p>+ Of course.</p></article><footer>Ends.</footer></body>""",
    """<body><main><p>+ One of the boats came back at noon with its sails torn and nobody on board but the cook.</p><p>+ Rain.</p><p>+ All day.</p><p>+ Rain.</p>
    <p>+ He said that they had left the others on the island, alive and well, and would fetch them soon.</p><p>+ So.</p></main><div>Contact</div><div><a href=1>Home</a></div></body>""",
    """<body><nav><li><a href=1>For all</a></li></nav><div class=ad>Of the to.</div><article><h1>+ In time</h1><p>+ Old.</p><p>+ It is as it was.</p><p>+ Go.</p></article><footer>A site of ours. We know who reads it and when they do.</footer></body>""",
]


def trained() -> Leaf | Split:
    found = [blocks(p) for p in LABELLED]
    return grow(features(found), np.array([b.text.startswith("+") for p in found for b in p], dtype=float))


def extract_text(pages: DataFrame, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without the html, with its main text (blocks joined by a line break) and that text's code points.

    A null or empty page, or one without main text, gives an empty text. The whole html is read, however long.
    Columns named ``text`` and ``n_chars`` are replaced, others pass through; an empty table gives an empty one.
    """
    pages = pages.drop(*[c for c in (text, n_chars) if c != html_col])
    rest = [f for f in pages.schema.fields if f.name != html_col]
    schema = StructType([*rest, StructField(text, StringType()), StructField(n_chars, LongType())])
    tree, at = trained(), pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in W.slices(batch, at)):
            found = [blocks(p or "") for p in b.column(at).to_pylist()]
            keep, k, out = classify(tree, features(found)), 0, []
            for page in found:
                out.append("\n".join(x.text for x, yes in zip(page, keep[k : k + len(page)]) if yes))
                k += len(page)
            rows = b.select([f.name for f in rest]).columns if rest else []
            yield pa.record_batch([*rows, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [f.name for f in schema.fields])

    return pages.mapInArrow(run, schema)
