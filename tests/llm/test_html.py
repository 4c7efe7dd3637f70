from __future__ import annotations

import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tablepulse.llm.html_text import _Lines, extract, main_text, weighted_lines
from tests.conftest import TESTDATA

LONG = "A paragraph that is long enough to make a peak in the distribution of the text over the lines of the page."
PAGES = {
    "": "", "no markup at all": "no markup at all",
    "<article><h1>T&eacute;st &amp;amp; more</h1><p>One<p>Two <b>bo</b>ld<br>new</article><footer>f</footer>": "Tést &amp; more One Two bold new",
    "<body><article><p>x</p><div class='ad big'>Buy</div><form><label>n</label></form><p>y</p></article>after": "x y",
    "<article><p>in</p><section class=comments><article><p>reader</p></article></section></article><article class='comment'>c</article>": "in",
    f"<nav><a>1</a><a>2</a></nav><div><p>{LONG}</p><p>Short.</p><aside>no</aside><p>End.</p></div><div id=footer>f</div>": f"{LONG} Short. End.",
    f"<ul><li><a href=x>Home</a><li><a>News</a><li><a>More</a><li><a>All</a></ul><h2><a>Title</a></h2><p>{LONG}</p>": f"Title {LONG}",
    f"<p>{LONG}</p>" + "<div class=widget>w</div>" * 3 + "<p>far away</p>": f"{LONG} far away",
    f"<p>{LONG}</p>" + "<div class=widget>w</div>" * 3 + "<div>far away</div>": LONG,
    f"<nav><a>1</a></nav><p>{LONG}</p>" + "<p><a href=x>linked para</a></p>" * 3 + "<p>Last.</p>": LONG + " linked para" * 3 + " Last.",
    f"<main><p>{LONG}</p><div class='popular'>Popular posts</div><div class='recent-posts'>x</div><p>End.</p></main>": f"{LONG} End.",
    f"<div><p>{LONG}</p></div><ul>" + "<li><a>l</a></li>" * 5 + "</ul><section><h2>Note</h2><p>Short last section.</p></section>": f"{LONG} Note Short last section.",
    "<article><p>a</p></article>" + "<div>between</div>" * 5 + "<article><p>b</p></article><div>after</div>": "a b",
    "<article><p>a</p><div>between</div></article><div>no</div><article><ul><li><a>b</a></li></ul></article>": "a between b",
    "<script>var t='</p><article>x';</script><style>p{}</style><p>a &lt; b &#x41;&#66; &nbsp; c &am</p><!-- <p>no</p> --><scr": "a < b AB c &am",
    "<article><p>a 1 < 2 and 3 > 2</p><p title='a > b' class=\"x\">q</p><p title='open>r</p></article>": "a 1 < 2 and 3 > 2 q r",
    "<header>site</header><article><header class='post-header'><h1>Title</h1></header><p>x</p><div class='side-bar'>no</div></article>": "Title x",
    "<div class=ad><article><p>kept</p></article>": "kept",
    "<article>" + "<p>w</p>" * 3000 + "</article>": " ".join(["w"] * 3000),
    "<html><head><title>t</title></head><body><header>h</header></body></html>": "",
    "<TEXTAREA><p>no</TEXTAREA><ARTICLE><P>yes</ARTICLE>": "yes",
}


@pytest.mark.parametrize("html", PAGES)
def test_main_text(html):
    assert main_text(html) == PAGES[html]


def test_stripped_blocks_do_not_part_an_article():
    aside = "<aside><ul><li>a<li>b<li>c</ul></aside>" + "<div class=ad>Buy</div>" * 4
    assert main_text(f"<article><p>{LONG}</p>{aside}<p>That is all.</p></article>") == f"{LONG} That is all."
    assert main_text(f"<div><p>{LONG}</p>{aside}<p>That is all.</p></div>") == f"{LONG} That is all."
    assert main_text(f"<div><p>{LONG}</p></div>{aside}<div><p>far away</p></div>") == f"{LONG} far away"
    assert main_text(f"<div><p>{LONG}</p></div>{aside}<div>far away</div>") == LONG


@pytest.mark.parametrize("mark", ["class='content with-sidebar'", "id='page' class='site no-sidebar'", "class=long-form", "class='ad-free search-terms'", "class=widget"])
def test_names_that_only_mention_boilerplate_strip_nothing(mark):
    assert main_text(f"<body><div {mark}><p>{LONG}</p><p class=share-price>Short.</p></div><div class='ad-box'>Buy</div></body>") == f"{LONG} Short."


def test_one_row_per_page(spark):
    rows = [(i, f"u{i}", h, "x") for i, h in enumerate([*PAGES, None])] + [(0, "u0", "", "y"), (None, None, "<p>z</p>", None)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = Counter((i, u, PAGES.get(h, "z" if h else ""), len(PAGES.get(h, "z" if h else ""))) for i, u, h, _ in rows)
    assert Counter(map(tuple, found)) == want
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_open_quotes_and_brackets_cost_no_more_than_their_length():
    assert main_text("<a \"" * 20_000) is not None
    assert main_text("<!--" * 50_000) == ""
    assert main_text("<" * 50_000) != ""


class Reference(HTMLParser):
    """The text blocks inside ``article`` by another parser: for pages that mark their article and close what they strip."""

    BLOCKS = frozenset(("article", "p", "div", "h1", "h2", "h3", "ul", "ol", "li", "br", "section", "blockquote", "table", "tr", "td"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skipped, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skipped += tag in ("script", "style", "aside", "form") or dict(attrs).get("class") == "ad"
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.depth -= tag == "article"
        self.skipped -= tag in ("script", "style", "aside", "form")

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.blocks[-1] += data


def marked_article(html):
    # An advert's div is closed before the article begins on these pages, so its own end tag ends the skipping.
    html = re.sub(r"<div class=\"ad\">.*?</div>", " ", html, flags=re.DOTALL)
    parser = Reference()
    parser.feed(html)
    parser.close()
    return " ".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))


@pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.01"), reason="test tables are not here")
def test_given_pages_match_another_parser(spark, capsys):
    rows = spark.read.parquet(f"{TESTDATA}/sf0.01/pages.parquet").select("html").collect()
    through = Counter()
    for row in rows:
        assert main_text(row.html) == marked_article(row.html)
        page = _Lines()
        page.read(row.html)
        through["with article" if page.saw_article else "without article"] += 1
        through["lines in the distribution"] += len(weighted_lines(page, 80))
    with capsys.disabled():
        print(f"pages through the line-block distribution: {dict(through)}")
    # The same pages with their articles marked by nothing but paragraphs.
    for row in rows[:200]:
        plain = row.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(plain) == marked_article(row.html)


def test_cost_grows_with_the_length_of_a_page_alone():
    for piece in ("<div>x", "<b>x<p>y", "<article><a>x", "</x><i>y</i><div>", "<div class=ad><a>x", "<section class=comments>x", "<h2><a>x</a>"):
        sizes = []
        for n in (4_000, 32_000):
            start = time.perf_counter()
            main_text(piece * n)
            sizes.append(time.perf_counter() - start)
        assert sizes[1] < 24 * sizes[0] + 0.5, piece  # eight times the page; a quadratic cost were 64 times as much


def test_random_nesting_keeps_every_paragraph_of_the_article():
    rng = random.Random(3)
    for _ in range(300):
        words = iter(range(10_000))
        kept = []

        def block(depth):
            kind = rng.random()
            if kind < 0.5 or depth > 6:
                word = f"w{next(words)}" + "x" * 60
                kept.append(word)
                return f"<p>{word}</p>" if rng.random() < 0.7 else f"<p><a href=x>{word}</a></p>"
            if kind < 0.65:
                return rng.choice(["<aside>{}</aside>", "<div class='ad'>{}</div>", "<nav><a>{}</a></nav>", "<form>{}</form>"]).format("no")
            name = rng.choice(["div", "section", "ul"])
            return f"<{name}>" + "".join(block(depth + 1) for _ in range(rng.randrange(4))) + f"</{name}>"

        body = "".join(block(0) for _ in range(rng.randrange(1, 6)))
        # A stripped part that holds most of a page's text would be spared, so pages need some.
        for page in (f"<article>{body}</article><p>no</p>", body) if kept else ():
            assert main_text(f"<html><body><header>no</header>{page}<footer>no</footer></body></html>") == " ".join(kept)
