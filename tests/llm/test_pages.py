"""Main text extraction against an independent walk of the parser of the standard library, and on broken and deep pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from courtlake.llm import pages as P

TREE = P.trained()
ARTICLE = [
    "The council met on Monday and spoke for three hours about the bridge, which has been shut since the flood in spring and will not open soon.",
    "Nobody was hurt.", "In the end it was agreed that a new bridge will be built of stone, since wood does not last in the river for more than some years.",
]
PROSE = "".join(f"<p>{t}</p>" for t in ARTICLE)
NAV, FOOT = "<nav><a href=/>Home</a> <a href=/b>News</a></nav>", "<div class=footer>Imprint and so on</div>"


def text(page):
    found = P.blocks(page)
    return "\n".join(b.text for b, yes in zip(found, P.classify(TREE, P.features([found]))) if yes)


class Walk(HTMLParser):
    """Visible text, cut at block-level tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.hidden = [], [], 0

    def cut(self):
        words = "".join(self.now).split()
        self.out += [" ".join(words)] if words else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in P.SKIPPED:
            self.hidden += 1
            self.now.append(" ")
        elif tag in P.BLOCK:
            self.cut()
        elif tag in ("br", "img"):
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in P.SKIPPED:
            self.hidden -= 1
        elif tag in P.BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)

    def close(self):
        super().close()
        self.cut()
        return self.out


def random_page(rng, depth=0):
    """Well-formed markup of blocks, inline elements, attributes in all three kinds of quotes, references, comments and what is never shown."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(9)
        if kind < 3 or depth > 4:
            out.append(rng.choice(["words here ", "a &amp; b ", "&#233;t&eacute; ", "x\n y ", "1 < 2 ", "<!-- no > way -->", "<br>", "<em>so</em> ", '<a href="/a>b">link</a> ']))
        elif kind == 3:
            out.append(rng.choice(["<script>if (a<b) { '</p>' }</script>", "<style>p > a {}</style>", "<noscript>no</noscript>", "<button>go</button>"]))
        else:
            tag = rng.choice(["div", "section", "ul", "blockquote", "article", "table", "h2"])
            out.append(f"<{tag} {rng.choice(['', 'id=a', 'title=\"x > y\"', 'title=<it>', 'data-x=1 hidden'])[:rng.choice([0, 40])]}>{random_page(rng, depth + 1)}</{tag}>".replace("title=<it>", "title='it is'"))
    return "".join(out)


def test_blocks_equal_those_of_another_parser():
    rng = random.Random(3)
    for _ in range(400):
        page = f"<html><body>{random_page(rng)}</body></html>"
        walk = Walk()
        walk.feed(page)
        assert [b.text for b in P.blocks(page)] == walk.close(), page


def test_built_pages_give_their_article_back():
    rng = random.Random(8)
    sides = [NAV, FOOT, "<aside><p>Ten ways to cook beans at home, and what else is new in the kitchen this week for all of us</p></aside>", "<header>The paper</header>",
             '<div class="cookie-notice">We use cookies here, as all do, to make this a better place for you. <a href=c>More</a></div>', "<form><p>Write to us if you like what you read here today.</p></form>"]
    for k in range(200):
        own = [f"{' '.join(rng.choice(ARTICLE[0].split()) for _ in range(rng.randrange(25, 60)))} end{k}." for _ in range(rng.randrange(2, 6))]
        before, behind = rng.sample(sides, 2), rng.sample(sides, 2)
        page = f"<html><body>{''.join(before)}<article>{''.join(f'<p>{p}</p>' for p in own)}</article>{''.join(behind)}</body></html>"
        assert text(page) == "\n".join(own)


@pytest.mark.parametrize("name", ["class='post tags-enabled'", "id=shop-news", "class=form-guide", "class=it's", 'title="x', "class='comment'"])
def test_a_container_of_most_words_is_the_page(name):
    assert text(f"<body>{NAV}<div {name}>{PROSE}</div>{FOOT}</body>").split("\n")[0] == ARTICLE[0]


def test_a_small_named_container_is_not():
    assert "beans" not in text(f"<body>{NAV}<div>{PROSE}</div><div class=related><p>Ten ways to cook beans at home in the summer, when nobody wants to stand in the kitchen.</p></div></body>")


def test_quotes_and_declarations():
    assert text(f"<body>{NAV}<p class=it's>{PROSE[3:]}</body>").split("\n")[0] == ARTICLE[0]
    assert text(f'<body>{NAV}<p title="x>{PROSE[3:]}</body>'.replace('="/', "=/")).split("\n")[0] == ARTICLE[0]
    assert "hidden" not in text(f"<body>{NAV}{PROSE}<![CDATA[ hidden words ]]></body>")
    assert "hidden" not in text(f"<body>{NAV}{PROSE}<!-- hidden > words hidden")


@pytest.mark.parametrize("page", ["<div>", "<p>x", "<b class=ad>", "<ul><div>", "</div><svg>", "<li><div></li>", '<a b="'])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    P.blocks(page * 200_000)
    P.blocks("<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000)
    assert time.process_time() - start < 20
