"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once from left to right, in time that grows with its length whatever
is broken in it, into blocks of text. A block is told by its words and link density,
by those of the blocks before and after it, and by four hints: whether it stands in a
part marked as boilerplate, in an article, in a heading, or beside an article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "boilerplate_part", "article_part", "heading", "beside_article")
#: Labelled blocks that the tree is trained on: the features in order, then 1 for main text.
LABELLED = (
    # pages whose parts are not marked: long text with few links, whatever stands beside it
    (80, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (40, 0.1, 80, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (60, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (100, 0.0, 1, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (160, 0.0, 4, 0.0, 6, 0.2, 0, 0, 0, 0, 1), (200, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (45, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (70, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (36, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1),
    (50, 0.2, 8, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (33, 0.25, 12, 0.0, 5, 0.0, 0, 0, 0, 0, 1), (90, 0.1, 2, 1.0, 70, 0.0, 0, 0, 0, 0, 1),
    # text of medium length: kept beside text, dropped between links
    (25, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (22, 0.0, 5, 0.0, 25, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 40, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (24, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (26, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 0, 1),
    (16, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0, 1), (28, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 45, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 70, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (13, 0.0, 30, 0.0, 12, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 6, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (24, 0.0, 4, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (15, 0.0, 2, 1.0, 5, 0.9, 0, 0, 0, 0, 0),
    (28, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (22, 0.1, 6, 0.8, 3, 1.0, 0, 0, 0, 0, 0), (18, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (12, 0.0, 3, 1.0, 4, 0.9, 0, 0, 0, 0, 0), (26, 0.0, 3, 0.9, 4, 1.0, 0, 0, 0, 0, 0), (14, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (16, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (11, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (20, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0, 0, 0),
    # short text there: kept among long text, and as the heading of long text
    (6, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 30, 0.0, 28, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 25, 0.0, 100, 0.0, 0, 0, 0, 0, 1), (12, 0.2, 40, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 22, 0.0, 24, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 2, 1.0, 70, 0.0, 0, 0, 1, 0, 1), (3, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1, 0, 1),
    (7, 0.0, 5, 0.8, 30, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 3, 0.0, 22, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 30, 0.0, 90, 0.0, 0, 0, 1, 0, 1),
    (9, 0.0, 4, 0.0, 50, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 35, 0.0, 0, 0, 1, 0, 1), (11, 0.0, 4, 0.0, 80, 0.0, 0, 0, 1, 0, 1),
    (8, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 3, 1.0, 80, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 50, 0.0, 0, 0, 0, 0, 0),
    # and dropped elsewhere, as is text that is mostly links
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (5, 0.8, 3, 1.0, 30, 0.0, 0, 0, 0, 0, 0),
    (30, 0.8, 20, 0.9, 25, 0.7, 0, 0, 0, 0, 0), (12, 0.6, 50, 0.0, 10, 0.8, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (6, 0.0, 5, 0.5, 3, 0.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 0.0, 4, 0.0, 0, 0, 0, 0, 0), (8, 0.3, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 0.4, 70, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (40, 0.6, 3, 1.0, 5, 0.9, 0, 0, 0, 0, 0),
    (4, 0.0, 100, 0.0, 3, 0.6, 0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (60, 0.9, 90, 0.0, 80, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 5, 0.0, 4, 0.0, 0, 0, 1, 0, 0), (2, 0.0, 80, 0.0, 3, 1.0, 0, 0, 1, 0, 0),
    (6, 0.0, 4, 0.0, 35, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 2, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 45, 0.0, 8, 0.0, 0, 0, 0, 0, 0),
    # article text, headings and short paragraphs among it, whatever stands beside them
    (8, 0.0, 3, 1.0, 90, 0.0, 0, 1, 1, 0, 1), (90, 0.0, 8, 0.0, 45, 0.0, 0, 1, 0, 0, 1), (45, 0.1, 90, 0.0, 3, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 45, 0.0, 60, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 30, 0.0, 12, 0.1, 0, 1, 0, 0, 1), (3, 0.0, 2, 0.0, 1, 0.0, 0, 1, 0, 0, 1),
    (300, 0.0, 20, 0.0, 20, 0.0, 0, 1, 0, 0, 1), (20, 0.3, 60, 0.0, 60, 0.0, 0, 1, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 1),
    (12, 0.0, 9, 0.0, 14, 0.1, 0, 1, 0, 0, 1), (7, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (4, 1.0, 80, 0.0, 70, 0.0, 0, 1, 0, 0, 1),
    (6, 0.0, 50, 0.0, 4, 1.0, 0, 1, 0, 0, 1), (2, 1.0, 6, 0.0, 2, 1.0, 0, 1, 0, 0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1),
    (3, 0.0, 40, 0.0, 1, 1.0, 0, 1, 1, 0, 1), (70, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0, 0, 1), (9, 0.6, 5, 0.8, 8, 0.7, 0, 1, 0, 0, 1),
    (1, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (4, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 0, 1), (35, 0.5, 1, 1.0, 2, 1.0, 0, 1, 0, 0, 1),
    (16, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0, 0, 1), (20, 0.0, 3, 1.0, 3, 1.0, 0, 1, 0, 0, 1), (30, 0.9, 40, 0.0, 40, 0.0, 0, 1, 0, 0, 1),
    # menus, headers, footers, sidebars: in a part that is marked as such
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0, 0), (6, 1.0, 4, 1.0, 12, 0.0, 1, 0, 0, 0, 0),
    (8, 0.0, 2, 1.0, 10, 0.0, 1, 0, 0, 0, 0), (14, 0.1, 40, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (25, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (60, 0.0, 90, 0.0, 20, 0.2, 1, 0, 0, 0, 0), (120, 0.0, 200, 0.0, 6, 0.0, 1, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    (22, 0.0, 30, 0.0, 28, 0.0, 1, 0, 0, 0, 0), (8, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1, 0, 0), (40, 0.0, 3, 1.0, 70, 0.0, 1, 0, 0, 0, 0),
    # the same inside an article: reader comments, adverts, forms
    (9, 0.0, 70, 0.0, 30, 0.0, 1, 1, 0, 0, 0), (45, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 0), (2, 0.5, 45, 0.0, 45, 0.0, 1, 1, 0, 0, 0),
    (150, 0.0, 10, 0.0, 150, 0.0, 1, 1, 0, 0, 0), (4, 0.0, 50, 0.0, 40, 0.0, 1, 1, 1, 0, 0), (3, 1.0, 20, 0.0, 3, 1.0, 1, 1, 0, 0, 0),
    # a page has an article, and these stand beside it
    (40, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 1, 0), (12, 0.0, 3, 1.0, 20, 0.0, 0, 0, 0, 1, 0), (4, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1, 1, 0),
    (120, 0.0, 5, 0.0, 8, 0.0, 0, 0, 0, 1, 0), (25, 0.1, 200, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (7, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 1, 0),
    (16, 0.0, 6, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (60, 0.2, 60, 0.0, 60, 0.0, 0, 0, 0, 1, 0), (2, 0.0, 22, 0.0, 80, 0.0, 0, 0, 1, 1, 0),
)

#: Elements whose text is never shown as such, or is a control.
DROPPED = frozenset("script style noscript template svg math iframe object canvas title select option button textarea audio video map".split())
#: Those of them that end where the same opens again, and those that take the rest of a page if left open: code.
ONCE = frozenset("button option select".split())
CODE = frozenset("script style".split())
#: Elements that hold boilerplate, those of them that may also stand around a page, and elements that hold an article.
BOILERPLATE = frozenset("nav footer aside dialog menu".split())
AROUND = frozenset("header form fieldset".split())
ARTICLE = frozenset("article main".split())
#: Words of a class, id or role that mark a part as boilerplate.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
MARKS = ADVERTS | COMMENTS | frozenset(
    "banner sidebar aside discussion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs related recommended recommendations share sharing social footer "
    "complementary contentinfo copyright disclaimer login search toolbar widget pagination pager tagcloud skip form".split()
)
#: Marks of a page's head; inside an article they stand for its own.
TOP = frozenset("header masthead".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_ANGLE = re.compile(r"[<>]")
#: Tags that end a dropped element whose own end tag is missing.
_FLOW = re.compile(r"</?(?:html|head|body|main|article|section|div|p|h[1-6]|ul|ol|dl|li|dt|dd|table|thead|tbody|tfoot|tr|td|th|caption|blockquote|pre|figure|figcaption|hr|address|details|summary|center|nav|header|footer|aside|form|dialog|menu|fieldset)(?=[\s/>])", re.I)
_OPTION = re.compile(r"</?(?:option|optgroup|select|datalist)(?=[\s/>])", re.I)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden(?![\w-])(?!\s*=\s*["']?(?:false|until))|display\s*:\s*none|\baria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


class _Page:
    """A page's text with searches that never look twice at what they have passed."""

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.next: dict = {}

    def find(self, what: str | re.Pattern, at: int) -> tuple[int, int]:
        """Where ``what`` stands next from ``at`` on and where it ends; the end of the page if nowhere. Places asked for only grow."""
        found = self.next.get(what)
        if found is None or found[0] < at:
            if isinstance(what, str):
                start = self.html.find(what, at)
                found = (self.end, self.end) if start < 0 else (start, start + len(what))
            else:
                m = what.search(self.html, at)
                found = m.span() if m else (self.end, self.end)
            self.next[what] = found
        return found

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose attributes start at ``at``: after ``>``, or before the next ``<`` if it was left open.

        A quoted value may hold both. A quote counts as left open if what would be
        its value holds either and no blank, slash or ``>`` comes after it; the tag then ends at the first of them.
        """
        html, i = self.html, at
        while True:
            i = _PLAIN.match(html, i).end()
            if i >= self.end:
                return self.end
            c = html[i]
            if c == ">":
                return i + 1
            if c == "<":
                return i
            if html[max(at, i - 64) : i].rstrip()[-1:] != "=":
                i += 1
                continue
            close = self.find(c, i + 1)[0]
            angle = _ANGLE.search(html, i + 1, close)
            if angle and (close >= self.end or html[close + 1 : close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">")):
                return angle.end() if angle[0] == ">" else angle.start()
            i = close + 1

    def dropped_to(self, tag: str, at: int) -> int:
        """Where a dropped element ends whose contents start at ``at``: after its end tag; if that is missing, at the first flow content or end of what is around it."""
        start, stop = self.find(_ENDS[tag], at)
        last = self.find(_AGAIN[tag], at)[0] if tag in ONCE else self.end
        if start <= last and start < self.end:
            return stop
        return last if tag in CODE else min(last, self.find(_FLOW, at)[0])


_ENDS = {tag: re.compile(rf"</{tag}\s{{0,64}}>", re.I) for tag in DROPPED}
_AGAIN = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.I) for tag in ONCE} | {"option": _OPTION}


@dataclass
class Part:
    """An element that is marked as boilerplate, and what stands in it."""

    above: int
    #: Whether it is boilerplate whatever it holds, and whether its marks are those of reader comments.
    sure: bool
    comments: bool
    #: Words outside of links, in all and in articles.
    words: int = 0
    article_words: int = 0
    bad: bool = False


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    #: Number of the innermost marked part, -1 if none, and whether an article that is no comment is around.
    part: int
    article: bool
    boilerplate: bool = False


@dataclass
class _Element:
    tag: str
    part: int
    #: Whether an article or main part is around, an article, and a comment.
    article: bool
    inside: bool
    comment: bool


@dataclass
class _Reader:
    """Turns a page's tags and text into blocks and marked parts."""

    out: list[Block] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("", -1, False, False, False)])
    opened: Counter = field(default_factory=Counter)
    texts: list[tuple[str, bool]] = field(default_factory=list)
    links: bool = False
    heading: bool = False
    #: The marked part that a paragraph or heading is by itself, and the inline advert that is open.
    own: int = -1
    advert: str = ""

    def text(self, text: str) -> None:
        if not self.advert:
            self.texts.append((text, self.links))

    def flush(self) -> None:
        if self.texts:
            text = " ".join(unescape("".join(t for t, _ in self.texts)).split())
            if text:
                linked = sum(len(unescape(t).split()) for t, a in self.texts if a)
                top = self.stack[-1]
                words = len(text.split())
                self.out.append(Block(text, words, min(words, linked), self.heading, top.part if self.own < 0 else self.own, top.article))
            self.texts = []

    def mark(self, attributes: str, tag: str, top: _Element) -> int:
        """The number of the part that an element is if it is marked, else that of the part around it."""
        marks = {w for v in _MARK.findall(attributes) for w in _WORDS.split("".join(v).lower())} if attributes else set()
        hidden = bool(attributes and _HIDDEN.search(attributes))
        known = COMMENTS if tag in ARTICLE else MARKS if top.article else MARKS | TOP
        weak = tag in AROUND and not (top.article and tag == "header")
        if tag in BOILERPLATE or weak or hidden or marks & known:
            self.parts.append(Part(top.part, tag in BOILERPLATE or hidden or top.inside, bool(marks & COMMENTS)))
            return len(self.parts) - 1
        return top.part

    def inline(self, tag: str, closing: bool, attributes: str) -> None:
        if self.advert:
            if closing and tag == self.advert:
                self.advert = ""
            return
        if tag == "a":
            self.links = not closing
        if tag in VOID:
            if tag in ("br", "img", "input"):
                self.texts.append((" ", self.links))
        elif attributes and not closing:
            marks = {w for v in _MARK.findall(attributes) for w in _WORDS.split("".join(v).lower())}
            if marks & ADVERTS or _HIDDEN.search(attributes):
                self.advert = tag

    def block(self, tag: str, closing: bool, attributes: str) -> None:
        self.flush()
        self.advert, self.links, self.own = "", False, -1
        self.heading = tag in HEADINGS and not closing
        if tag in VOID or tag in ("html", "body"):
            return
        top = self.stack[-1]
        if tag == "p" or tag in HEADINGS:
            if not closing:
                at = self.mark(attributes, tag, top)
                self.own = at if at != top.part else -1
        elif not closing:
            part = self.mark(attributes, tag, top)
            comment = top.comment or part != top.part and self.parts[part].comments and tag in ARTICLE
            self.stack.append(_Element(tag, part, not comment and (top.article or tag in ARTICLE), not comment and (top.inside or tag == "article"), comment))
            self.opened[tag] += 1
        elif self.opened[tag]:
            while True:
                gone = self.stack.pop().tag
                self.opened[gone] -= 1
                if gone == tag:
                    break

    def judged(self) -> list[Block]:
        """The blocks, once it is settled which parts are boilerplate.

        Some are by their element, or as they are hidden or stand inside an article. The
        marks of others say nothing if the part is the page itself: if it holds most
        of the words of its articles or, on a page without, at least half of all text.
        """
        for b in self.out:
            if b.part >= 0:
                self.parts[b.part].words += b.words - b.link_words
                self.parts[b.part].article_words += b.article * b.words
        for p in reversed(self.parts):
            if p.above >= 0:
                self.parts[p.above].words += p.words
                self.parts[p.above].article_words += p.article_words
        words, article_words = sum(b.words - b.link_words for b in self.out), sum(b.words for b in self.out if b.article)
        for p in self.parts:
            part, whole, most = (p.article_words, article_words, 0.8) if article_words else (p.words, words, 0.5)
            p.bad = p.sure or p.above >= 0 and self.parts[p.above].bad or part < (0.9 if p.comments else most) * whole or whole == 0
        for b in self.out:
            b.boilerplate = b.part >= 0 and self.parts[b.part].bad
        return self.out


def blocks(html: str) -> list[Block]:
    """Runs of text between block-level tags, in page order, without empty ones."""
    page, reader, at = _Page(html), _Reader(), 0
    while at < page.end:
        start = html.find("<", at)
        if start < 0:
            start = page.end
        if start > at:
            reader.text(html[at:start])
        if start == page.end:
            break
        m = _NAME.match(html, start)
        if m:
            tag, closing = m[2].lower(), bool(m[1])
            at = page.tag_end(m.end())
            attributes = html[m.end() : at]
            if tag in DROPPED:
                if not closing and not attributes.rstrip("> \t\n\r").endswith("/"):
                    at = page.dropped_to(tag, at)
                reader.text(" ")
            elif tag == "head":  # what it holds is dropped or has no text, and its end tag may be missing
                reader.text(" ")
            elif tag in INLINE:
                reader.inline(tag, closing, attributes)
            else:
                reader.block(tag, closing, attributes)
        elif html.startswith("<!--", start):
            at = page.find("-->", start + 2)[1]
        elif html.startswith("<![CDATA[", start):
            at = page.find("]]>", start)[1]
        elif html[start + 1 : start + 2] in ("!", "?") or html.startswith("</", start):
            at = page.find(">", start)[1]
        else:
            reader.text("<")
            at = start + 1
    reader.flush()
    return reader.judged()

def table_of(found: list[Block]) -> np.ndarray:
    """The features of each block, neighbours included."""
    words = np.array([0.0, *(b.words for b in found), 0.0])
    links = np.array([0.0, *(b.link_words / b.words for b in found), 0.0])
    has_article = any(b.article and not b.boilerplate for b in found)
    marks = np.array([[b.boilerplate, b.article, b.heading, has_article and not b.article] for b in found], dtype=float).reshape(-1, 4)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], marks])


class Tree:
    """A decision tree that splits on the greatest fall of the Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.value, self.split = float(y.mean()), None
        if depth == 0 or y.min() == y.max():
            return
        best = (-1.0, 0, 0.0)
        for k in range(x.shape[1]):
            levels = np.unique(x[:, k])
            for cut in (levels[1:] + levels[:-1]) / 2:
                low = y[x[:, k] <= cut]
                high = y[x[:, k] > cut]
                fall = y.var() - (len(low) * low.var() + len(high) * high.var()) / len(y)
                if fall > best[0] + 1e-12:
                    best = (fall, k, float(cut))
        if best[0] <= 0:
            return
        _, k, cut = best
        low = x[:, k] <= cut
        self.split = k, cut, Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        k, cut, low, high = self.split
        out, left = np.empty(len(x)), x[:, k] <= cut
        out[left], out[~left] = low(x[left]), high(x[~left])
        return out


def train(labelled=LABELLED) -> Tree:
    data = np.array(labelled, dtype=float)
    return Tree(data[:, :-1], data[:, -1])


def splits(tree: Tree) -> list[str]:
    """The nodes of a tree, from the top, as text."""
    if tree.split is None:
        return [f"main text: {tree.value:.2f}"]
    k, cut, low, high = tree.split
    return [f"{FEATURES[k]} <= {cut:g}", *("  " + x for x in splits(low)), f"{FEATURES[k]} > {cut:g}", *("  " + x for x in splits(high))]


def main_text(html: str | None, tree: Tree) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    return "\n".join(b.text for b, yes in zip(found, tree(table_of(found)) >= 0.5) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, url, text and n_chars.

    Character references are decoded, white space in a block becomes one space, and
    the blocks of main text are joined by line ends. A null html counts as empty and
    has an empty text. Tags, quotes and comments left open do no harm, but for script,
    style, comments and CDATA, which take the rest of a page; however broken or long
    a page is, the time grows with its length. Repeated pages and null ids stay as
    they are; other columns are ignored; an empty table gives an empty table.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices_of(batch, "html"):
                texts = [main_text(h.as_py(), tree) for h in some.column("html")]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
