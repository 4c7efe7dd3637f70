"""Main text of web pages by line-block distribution.

1. Strip markup: the page is read tag by tag into lines, one per block element. Inline elements do not break a line.
   Subtrees that are no article text by their element (scripts, styles, navigation, headers, footers, asides, forms) or
   by a name among their class, id or role (menus, sidebars, notices, adverts, reader comments) give empty lines. A name
   counts if it is one of the list or a compound of the list and of ``NEUTRAL`` words; a subtree that holds most of the
   page's text outside links is not stripped for one word of a name. A header inside an article holds its title and stays.
2. Weights: a line weighs as many characters as it has outside links, so that lists of links weigh nothing; links in
   a paragraph are part of its text. Where a page has ``article`` or ``main``, lines outside weigh nothing. Lines inside,
   and on other pages paragraphs, weigh ``MIN_PEAK`` more, however short they are.
3. Distribution: weights are summed over sliding windows of ``WINDOW`` lines.
4. Surge and dive: a region begins where the sum rises from zero and ends where it falls back to zero, so a region
   survives gaps shorter than the window, such as an advert inside an article. Stripped lines inside an article, or
   between two lines of one element other than the body, are no gap, however many they are.
5. Regions whose highest sum reaches ``MIN_PEAK`` are kept, and the highest one always; their non-empty lines are the
   text. Inside a region nothing is dropped, however short.

All pages take these steps. Character references are decoded once. White space inside a line becomes one space, lines are
joined by one space. NULL and empty pages, and pages without article text, give an empty text. A tag that the page's end
cuts off is markup. Unclosed elements end with the element around them; elements may be nested to any depth, at a cost
that grows with the length of the page alone. Repeated rows get the same text each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
MIN_PEAK = 80

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video select textarea button"
    " nav header footer aside form menu dialog fieldset".split()
)
ARTICLE = frozenset(("article", "main"))
# Names in class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead skip"
    " header footer copyright contentinfo sidebar aside complementary widget related recommended teaser"
    " notice alert cookie cookies consent gdpr popup modal overlay dialog newsletter subscribe subscription signup login"
    " popular trending recent latest search form share sharing social toc disclaimer adsbygoogle outbrain taboola paywall".split()
)
# The head of an article holds its title; that of a page does not.
HEADERS = frozenset(("header", "masthead"))
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
# Words that say where or in what a part stands; compounds with any other word (with-sidebar, long-form, ad-free) mark nothing.
NEUTRAL = frozenset(
    "container wrapper wrap box block area section list item items link links bar site page main global top bottom left right"
    " primary secondary post posts article articles entry button buttons icon icons inner outer slot unit text title message"
    " body author meta thread count feed panel policy row col column group fixed sticky mobile desktop user reader bottom".split()
)
RAW = frozenset(("script", "style", "textarea", "title"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PROSE = frozenset(("p", "blockquote", "pre"))  # what holds running text, linked or not
_NAME = re.compile(r"[A-Za-z]+")
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
# Comments, tags (a tag whose quotes do not match ends at the first ">"), declarations. No group gives back characters.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<slash>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>"""
    r"""|<[!?][^>]*+>""",
    re.DOTALL,
)
_CUT_TAG = re.compile(r"<(?:[A-Za-z/!][^<>]*)?\Z")


def _names(attributes: str) -> set[str]:
    """The words of names that mark something, whole or in a known compound; ``side-bar`` is also a ``sidebar``."""
    marked = set()
    for name in (n for value in _MARKS.findall(attributes) for n in value.strip("\"'").lower().split()):
        words = _NAME.findall(name)
        whole = "".join(words)
        if whole in BOILERPLATE or whole in COMMENTS:
            marked.add(whole)
        elif all(w in BOILERPLATE or w in COMMENTS or w in NEUTRAL or len(w) == 1 for w in words):
            marked.update(words)
    return marked


@dataclass(frozen=True)
class _Line:
    text: str
    unlinked: int  # characters outside links
    prose: bool  # in a paragraph or the like
    inside: bool  # an article
    around: tuple[int, ...]  # the block that holds it and the one around that


class _Lines:
    """The lines of a page, and the elements that are open while it is read."""

    def __init__(self, spared: frozenset[int] = frozenset()):
        self.spared = spared  # elements that are not stripped for their name
        self.unlinked = 0  # characters so far that are in no link and not stripped by element
        self.named: dict[int, int] = {}  # that number where an element stripped for one word began, then what it holds
        self.lines: list[_Line] = []
        self.ids: list[int] = []  # of the open elements
        self.n_elements = 0
        self.open: list[tuple[str, str]] = []  # element, and how its text counts: text, article, link, none, named or comments
        self.blocks: list[int] = []  # where in this list the blocks are
        self.names: Counter[str] = Counter()  # of the open elements, so that no line has to walk through them
        self.kinds: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = 0
        self.filled = False  # some text, kept or not, since the last line
        self.saw_article = False

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        for tag in _TAG.finditer(html):
            if tag.start() < at:
                continue  # inside a script or the like
            if tag.start() > at:
                self.data(html[at : tag.start()])
            at = tag.end()
            name = tag["name"]
            if name is None:
                continue  # a comment or declaration
            name = name.lower()
            if tag["slash"]:
                self.end(name)
            elif tag["attributes"].endswith("/"):
                self.start(name, "", empty=True)
            else:
                self.start(name, tag["attributes"], empty=name in VOID)
                if name in RAW:
                    close = re.compile(f"</{name}(?![A-Za-z0-9])", re.IGNORECASE).search(html, at)
                    at = close.start() if close else end
        if at < end:
            self.data(_CUT_TAG.sub("", html[at:]))
        self.end_line()
        self.close(0)

    def most(self) -> frozenset[int]:
        """The elements named by one word that hold most of the text."""
        return frozenset(i for i, held in self.named.items() if 2 * held > self.unlinked)

    def end_line(self) -> None:
        """A line for what came since the last one; text that does not count makes an empty line."""
        if self.filled:
            text = " ".join("".join(self.text).split())
            around = tuple(self.ids[i] for i in self.blocks[-2:] if self.open[i][0] not in ("html", "body"))
            prose = bool(self.blocks) and self.open[self.blocks[-1]][0] in PROSE
            self.lines.append(_Line(text, max(0, len(text) - self.linked), prose, self.kinds["article"] > 0, around))
            self.text, self.linked, self.filled = [], 0, False

    def start(self, name: str, attributes: str, empty: bool) -> None:
        if name not in INLINE:
            self.end_line()
        if empty:
            return
        if name == "p" and any(n == "p" for n, _ in self.open[-4:]):
            self.end("p")
        before = self.open[-1][1] if self.open else "text"
        names = _names(attributes) if attributes else frozenset()
        if name in ARTICLE:
            kind = "comments" if before == "comments" or names & COMMENTS else "article"
            self.saw_article |= kind == "article"
        elif name in ("html", "body") or before in ("none", "comments"):
            kind = before
        elif before == "named":
            self.name_held(names)
            kind = "none" if name in NO_TEXT else before
        elif names & COMMENTS:
            kind = "comments"
        elif name in NO_TEXT or names & BOILERPLATE:
            titled = {name, *names} & (NO_TEXT | BOILERPLATE) <= HEADERS and self.kinds["article"] > 0
            kind = before if titled else "none" if name in NO_TEXT else "named"
            if kind == "named":
                self.name_held(names)
                kind = before if self.n_elements in self.spared else kind
        elif name == "a" and not any(self.names[n] for n in HEADINGS) and not (self.blocks and self.open[self.blocks[-1]][0] in PROSE):
            kind = "link"
        else:
            kind = before if before == "link" else "text"
        if name not in INLINE:
            self.blocks.append(len(self.open))
        self.names[name] += 1
        self.kinds[kind] += 1
        self.open.append((name, kind))
        self.ids.append(self.n_elements)
        self.n_elements += 1

    def end(self, name: str) -> None:
        """Ends the nearest open element of this name and all in it; a stray end tag ends nothing."""
        if name not in INLINE:
            self.end_line()
        if not self.names[name]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.close(i)
                return

    def name_held(self, names: set[str]) -> None:
        if len(names & BOILERPLATE) == 1:
            self.named[self.n_elements] = self.unlinked

    def close(self, i: int) -> None:
        for number in self.ids[i:]:
            if number in self.named:
                self.named[number] = self.unlinked - self.named[number]
        for name, kind in self.open[i:]:
            self.names[name] -= 1
            self.kinds[kind] -= 1
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()
        del self.open[i:], self.ids[i:]

    def data(self, data: str) -> None:
        if data.isspace():
            if self.text:
                self.text.append(" ")
            return
        self.filled = True
        kind = self.open[-1][1] if self.open else "text"
        if kind in ("none", "comments"):
            return
        if kind != "link" and not (kind == "named" and self.names["a"]):
            self.unlinked += len(data.strip())
        if kind == "named":
            return
        data = unescape(data) if "&" in data else data
        self.text.append(data)
        if kind == "link":
            self.linked += len(data)


def weighted_lines(page: _Lines, bonus: int) -> list[tuple[str, int]]:
    """The text of every line and its weight in the distribution; lines that are no article text are empty or weigh nothing."""
    lines: list[tuple[str, int]] = []
    last: tuple[int, ...] = ()
    stripped: list[tuple[str, int]] = []
    for line in page.lines:
        if not line.text:
            if not line.inside:
                stripped.append(("", 0))
            continue
        if not set(line.around) & set(last):
            lines += stripped
        if page.saw_article:
            weight = len(line.text) + bonus if line.inside else 0
        else:
            weight = line.unlinked + (bonus if line.prose else 0)
        lines.append((line.text, weight))
        last, stripped = line.around, []
    return lines + stripped


def main_text(html: str | None, window: int = WINDOW, min_peak: int = MIN_PEAK) -> str:
    page = _Lines()
    page.read(html or "")
    if spared := page.most():
        page = _Lines(spared)
        page.read(html or "")
    lines = weighted_lines(page, min_peak)
    weights = np.array([0] * (window - 1) + [n for _, n in lines] + [0] * (window - 1), np.int64)
    sums = np.convolve(weights, np.ones(window, np.int64), "valid")  # sums[i]: lines i-window+1 .. i
    above = np.concatenate(([False], sums > 0, [False]))
    surges, dives = np.flatnonzero(~above[:-1] & above[1:]), np.flatnonzero(above[:-1] & ~above[1:])
    peaks = [int(sums[a:b].max()) for a, b in zip(surges, dives, strict=True)]
    needed = min(min_peak, max(peaks, default=0))
    kept = []
    for a, b, peak in zip(surges.tolist(), dives.tolist(), peaks, strict=True):
        if peak >= needed:
            kept += [text for text, weight in lines[a : b - window + 1] if text and (weight or not page.saw_article)]
    return " ".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
