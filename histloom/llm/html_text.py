"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks: boilerplate containers and
link-heavy blocks are bad, long ones rich in stop words are good; what is short or poor in stop words
stays open. An article is a bias: inside, half the length or any share of stop words will do. Pass two
lets open blocks inherit: those of an article with good blocks are good, all others take the label of
their nearest decided neighbours. Good blocks are joined in page order.

Defined results: null and empty pages, and pages without good blocks, give the empty text; unclosed
tags end with their parent; white space inside a block is one space. Nothing is cut by length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom.llm.common import by_value

by_value(__name__)

LONG = 70
STOP_SHARE = 0.2
LINK_SHARE = 0.5

# Elements and hints.
RAW = frozenset("script style noscript template title textarea svg math iframe object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
ENDED_BY_SAME = frozenset("li dt dd td th tr option".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog search button select head".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
    "toolbar status".split()
)
BAD_HINTS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted "
    "recommended related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription tags teaser toolbar topbar widget".split()
)
# Of an article or main element; its other classes tell topics and states, not what it is.
ARTICLE_HINTS = frozenset(
    "ad advert advertisement comment comments promo promoted recommended related replies respond sponsor "
    "sponsored teaser".split()
)
STATE_HINTS = frozenset("category has no tag with".split())
HEADER_HINTS = frozenset(("header",))
GOOD_HINTS = frozenset("article body content entry main post story text".split())
STOP_WORDS = frozenset(
    # English
    "a an and are as at be but by for from had has have he her his in into is it its not of on or "
    "she that the their there they this to was were which who will with you "
    # French
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur ne nous par pas plus pour "
    "qui que sa se ses son sont sur un une "
    # German
    "aber auch auf aus bei bin das dass dem den der die ein eine einem einen einer er es für hat ich "
    "ihr im ist mit nach nicht oder sich sie sind und von war wie wir zu zum zur "
    # Spanish, Italian, Portuguese, Dutch
    "al como con del el los las lo más no para pero por su y che di è gli non o per com uma os het "
    "een van".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|style|aria-hidden)\b\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+",
    re.I,
)
_NAME = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"']++)?+)?+")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    text: str
    bad: bool
    article: int  # number of the outermost article around, 0 for none
    heading: bool
    link_share: float


def _hinted(name: str, attributes: str) -> tuple[bool, bool]:
    """(boilerplate, header) by element, role, class and id."""
    bad, header = name in BOILERPLATE, name == "header"
    if not attributes or name in ("html", "body"):
        return bad, header
    for found in _ATTRIBUTE.finditer(attributes):
        key = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            bad = True
        elif key == "style":
            packed = value.replace(" ", "").lower()
            bad |= "display:none" in packed or "visibility:hidden" in packed
        elif key == "role":
            bad |= value.lower() in ROLES
        elif key in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _PARTS.findall(one)}
                if name in ARTICLE:
                    bad |= bool(parts & ARTICLE_HINTS) and not parts & (GOOD_HINTS | STATE_HINTS)
                    continue
                if not parts & GOOD_HINTS:
                    bad |= bool(parts & BAD_HINTS)
                header |= bool(parts & HEADER_HINTS)
    return bad, header


class _Page:
    """Collects blocks while tags go by; only what hides or ends blocks is on the stack."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self._stack: list[tuple[str, bool, bool, int, bool]] = []
        self._articles = 0
        self._pieces: list[str] = []
        self._linked = 0
        self._in_link = False
        self._link_depth = 0
        self._link_closed = True
        self._breaks = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        if not raw.isspace():
            self._breaks = 0
        piece = html.unescape(raw)
        self._pieces.append(piece)
        if self._in_link:
            self._linked += len(_SPACE.sub(" ", piece).strip())

    def end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self._pieces)).strip()
        if text:
            name, bad, header, article, _ = self._state()
            heading = any(s[0] in HEADINGS for s in self._stack)
            # A header belongs to the page, unless it is an article's: then its headings stay.
            bad = bad or (header and not (article and heading))
            self.blocks.append(Block(text, bad, article, heading, self._linked / len(text)))
        self._pieces.clear()
        self._linked = self._breaks = 0
        # A link without an end tag ends with its block; one with it may hold blocks.
        self._in_link &= self._link_closed

    def _cut(self, depth: int) -> None:
        del self._stack[depth:]
        self._in_link &= depth >= self._link_depth

    def _state(self) -> tuple[str, bool, bool, int, bool]:
        return self._stack[-1] if self._stack else ("", False, False, 0, False)

    def open(self, name: str, attributes: str, closed: bool = True) -> None:
        """``closed`` tells of an anchor whether its end tag comes before the next anchor."""
        if name == "a":
            self._in_link = any(n[1].lower() == "href" for n in _NAME.finditer(attributes))
            self._link_depth, self._link_closed = len(self._stack), closed
        if name == "br":
            self._breaks += 1
            self._pieces.append(" ")
            if self._breaks > 1:
                self.end_block()
            return
        block = name in BLOCKS
        bad, header = _hinted(name, attributes)
        if block:
            self.end_block()
            while self._stack and self._stack[-1][0] in ENDED_BY_BLOCK:
                self._cut(len(self._stack) - 1)
            if name in ENDED_BY_SAME and self._stack and self._stack[-1][0] == name:
                self._cut(len(self._stack) - 1)
        if name in EMPTY or not (block or bad or header):
            return
        _, was_bad, was_header, was_article, _ = self._state()
        if not block:
            self.end_block()
        if name in ARTICLE and not was_article:
            self._articles += 1
            was_article = self._articles
        self._stack.append((name, was_bad or bad, was_header or header, was_article, block))

    def close(self, name: str) -> None:
        if name == "a":
            self._in_link = False
        block = name in BLOCKS
        if block:
            self.end_block()
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                self.end_block()
                self._cut(i)
                return
            # An inline tag does not close the block around it.
            if not block and self._stack[i][4]:
                return


def blocks_of(page: str) -> list[Block]:
    found, at = _Page(), 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            break
        found.text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["close"]:
            found.close(name)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            anchor = _ANCHOR.search(page, at) if name == "a" else None
            found.open(name, token["attributes"], anchor is not None and anchor[1] == "/")
    found.text(page[at:])
    found.end_block()
    return found.blocks


def stop_share(text: str) -> float:
    words = _WORD.findall(text)
    return sum(w.lower() in STOP_WORDS for w in words) / len(words) if words else 0.0


def labels(blocks: list[Block]) -> list[bool]:
    """True for main text."""
    first: list[bool | None] = []
    for b in blocks:
        if b.bad or b.link_share > LINK_SHARE:
            first.append(False)
        elif len(b.text) >= LONG and (b.article or stop_share(b.text) >= STOP_SHARE):
            first.append(True)
        elif b.article and len(b.text) >= LONG / 2 and stop_share(b.text) >= STOP_SHARE:
            first.append(True)
        else:
            first.append(None)
    if True not in first:
        # No stop word tells this language: length alone decides, then being open does.
        first = [
            True if x is None and len(b.text) >= LONG else x
            for x, b in zip(first, blocks, strict=True)
        ]
    if True not in first:
        first = [x is None for x in first]
    good = {b.article for x, b in zip(first, blocks, strict=True) if x and b.article}
    first = [
        True if x is None and b.article in good else x for x, b in zip(first, blocks, strict=True)
    ]
    return _inherited(first, [b.heading for b in blocks])


def _inherited(first: list[bool | None], heading: list[bool]) -> list[bool]:
    """Open blocks take the nearest decided label; between unlike ones at equal distance a
    heading goes with what follows it, any other block is dropped."""
    n, far = len(first), len(first) + 1
    before, after = [(far, False)] * n, [(far, False)] * n
    seen = (far, False)
    for i in range(n):
        seen = (0, first[i]) if first[i] is not None else (seen[0] + 1, seen[1])
        before[i] = seen
    seen = (far, False)
    for i in range(n - 1, -1, -1):
        seen = (0, first[i]) if first[i] is not None else (seen[0] + 1, seen[1])
        after[i] = seen
    out = []
    for i in range(n):
        if first[i] is not None:
            out.append(first[i])
        elif before[i][0] == after[i][0] and before[i][1] != after[i][1]:
            out.append(heading[i] and after[i][1])
        else:
            out.append(min(before[i], after[i], key=lambda x: x[0])[1])
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, one per line."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, labels(blocks), strict=True) if good)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return udf(page)


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` but the markup, with the main text as ``out``."""
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (html_column, out)]
    return pages.select(*others, extracted(F.col(f"`{html_column}`")).alias(out))
