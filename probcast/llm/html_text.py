"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count and link density, those
of the blocks before and after it, whether it is a heading, whether it lies in an element that holds
an article, and how surely it lies in page furniture (menu, advert, notice, form, comments and the
like): 1 by an element's tag, because it is hidden, or by a plain name such as comments, advert, notice,
sidebar or footer; 0.5 by an ambiguous name or an own form, which long text without links overrules.
Names end at an article or main element, unless the page has another article outside such a name. A
decision tree grown on the labelled table ``EXAMPLES`` decides which blocks are main text. Scripts, styles, comments, the head and all markup are dropped, character
references are decoded, white space inside a block becomes one space, and blocks are joined by blank
lines in page order.

Defined cases: a null or empty page and a page without main text give an empty text; unclosed
scripts, styles, comments and cut-off tags end with the page; an unclosed head ends where the body begins,
and of other unclosed dropped elements only the tag goes; repeated rows are extracted each on its own; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import bounded_batches, text_slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE)
# Elements dropped up to their end tag; where none follows, only the tag itself is dropped.
DROPPED = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "noscript template svg iframe object canvas".split()}
HEAD_TAGS = set("base basefont bgsound link meta title noframes".split()) | set(DROPPED)
ATTRIBUTES = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = {"article", "main"}
FURNITURE_TAGS = set("nav footer aside form menu dialog button select option textarea label fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FURNITURE_NAMES = set(
    "nav navbar navigation menu menubar header masthead footer foot sidebar side aside ad ads adv advert advertisement "
    "adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay subscribe subscription newsletter signup share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond discussion disqus breadcrumb breadcrumbs pagination pager "
    "form login search toolbar widget copyright legal disclaimer hidden tags taglist tracking contentinfo "
    "complementary".split())
# Names that text of a page may also bear: long text without links overrules them.
AMBIGUOUS_NAMES = set("side share sharing social related recommended recommendations widget legal disclaimer copyright "
                      "form login search toolbar tags taglist tracking hidden signup header masthead".split())
LAYOUT_NAMES = {"layout"}
# Names that say what a wrapper has or is filed under, and names of what holds text.
ABOUT_NAMES = set("has with without no not tag category cat".split())
TEXT_NAMES = set("text editor article post entry story body".split())
FORM_WORDS = 100  # a form with so many words outside links wraps the page
PAGE_TAGS = {"html", "body"}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after",
            "heading", "in_article", "in_furniture")

# Blocks labelled by hand. Columns as in FEATURES, then 1 for main text.
EXAMPLES = [
    # paragraphs of marked articles, long and short
    (120, 0.0, 90, 0.0, 80, 0.0, 0, 1, 0, 1), (60, 0.05, 9, 0.0, 70, 0.0, 0, 1, 0, 1),
    (35, 0.0, 60, 0.0, 12, 0.2, 0, 1, 0, 1), (12, 0.0, 40, 0.0, 25, 0.0, 0, 1, 0, 1),
    (5, 0.0, 80, 0.0, 14, 0.1, 0, 1, 0, 1), (1, 0.0, 100, 0.0, 10, 0.0, 0, 1, 0, 1),
    (2, 0.0, 6, 0.0, 3, 0.0, 0, 1, 0, 1), (18, 0.4, 50, 0.0, 60, 0.0, 0, 1, 0, 1),
    (300, 0.01, 4, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 5, 0.0, 12, 0.0, 0, 1, 0, 1),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (25, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1),
    # headings and list items of marked articles
    (9, 0.0, 4, 0.0, 80, 0.0, 1, 1, 0, 1), (3, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0, 1),
    (11, 0.0, 1, 1.0, 11, 0.0, 1, 1, 0, 1), (6, 0.0, 8, 0.0, 7, 0.0, 0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 60, 0.0, 0, 1, 0, 1), (1, 1.0, 30, 0.0, 30, 0.0, 0, 1, 0, 1),
    # blocks of marked articles before link lists, and at their end
    (5, 0.0, 30, 0.0, 3, 1.0, 0, 1, 0, 1), (50, 0.0, 40, 0.0, 2, 1.0, 0, 1, 0, 1),
    (20, 0.1, 30, 0.0, 1, 1.0, 0, 1, 0, 1), (3, 1.0, 20, 0.0, 3, 1.0, 0, 1, 0, 1),
    (8, 0.0, 2, 1.0, 1, 1.0, 1, 1, 0, 1), (90, 0.0, 80, 0.0, 1, 1.0, 0, 1, 0, 1),
    (2, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 1), (1, 0.0, 2, 0.0, 1, 1.0, 0, 1, 0, 1),
    (40, 0.9, 20, 0.0, 30, 0.9, 0, 1, 0, 1), (9, 0.7, 4, 1.0, 5, 1.0, 0, 1, 0, 1),
    # furniture outside and inside articles
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0),
    (1, 1.0, 1, 1.0, 5, 0.0, 0, 0, 1, 0), (5, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 0),
    (9, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0),
    (20, 0.1, 90, 0.0, 0, 0.0, 0, 0, 1, 0), (40, 0.0, 30, 0.0, 22, 0.0, 0, 0, 1, 0),
    (80, 0.02, 15, 0.0, 12, 0.0, 0, 0, 1, 0), (150, 0.0, 60, 0.0, 9, 0.0, 0, 0, 1, 0),
    (6, 0.5, 9, 0.0, 5, 0.0, 0, 0, 1, 0), (3, 0.0, 5, 0.0, 8, 0.3, 1, 0, 1, 0),
    (4, 0.0, 12, 0.0, 20, 0.0, 1, 0, 1, 0), (12, 0.0, 60, 0.0, 60, 0.0, 0, 1, 1, 0),
    (30, 0.0, 80, 0.0, 70, 0.0, 0, 1, 1, 0), (3, 1.0, 40, 0.0, 4, 1.0, 0, 1, 1, 0),
    (5, 0.0, 90, 0.0, 20, 0.0, 1, 1, 1, 0), (60, 0.0, 6, 0.0, 45, 0.0, 0, 1, 1, 0),
    # unmarked pages: text by length and links
    (120, 0.0, 90, 0.0, 80, 0.0, 0, 0, 0, 1), (45, 0.05, 6, 0.0, 60, 0.0, 0, 0, 0, 1),
    (70, 0.1, 2, 1.0, 50, 0.0, 0, 0, 0, 1), (30, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1),
    (18, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (12, 0.0, 35, 0.0, 28, 0.1, 0, 0, 0, 1),
    (6, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0, 1), (3, 0.0, 55, 0.0, 90, 0.0, 0, 0, 0, 1),
    (22, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (25, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (40, 0.2, 30, 0.0, 3, 0.0, 0, 0, 0, 1),
    (8, 0.0, 3, 0.5, 90, 0.0, 1, 0, 0, 1), (5, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1),
    (10, 0.0, 2, 1.0, 75, 0.0, 1, 0, 0, 1), (4, 0.0, 0, 0.0, 110, 0.0, 1, 0, 0, 1),
    (70, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 1), (90, 0.02, 50, 0.0, 1, 1.0, 0, 0, 0, 1),
    (50, 0.0, 6, 0.0, 4, 0.8, 0, 0, 0, 1), (15, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 1),
    (130, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (24, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1),
    (9, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
    # unmarked pages: short blocks among furniture, link lists
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0),
    (5, 0.8, 3, 1.0, 4, 0.7, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.5, 0, 0, 0, 0), (6, 0.0, 4, 0.6, 3, 0.0, 0, 0, 0, 0),
    (12, 0.7, 5, 1.0, 9, 0.8, 0, 0, 0, 0), (25, 0.9, 4, 1.0, 6, 0.9, 0, 0, 0, 0),
    (60, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (7, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 0.3, 80, 0.0, 0, 0.0, 0, 0, 0, 0), (8, 0.6, 100, 0.0, 4, 1.0, 0, 0, 0, 0),
    (5, 0.0, 1, 1.0, 4, 0.9, 1, 0, 0, 0), (3, 0.0, 3, 0.0, 2, 1.0, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (12, 0.9, 1, 1.0, 90, 0.0, 0, 0, 0, 0),
    (4, 1.0, 0, 0.0, 100, 0.0, 0, 0, 0, 0), (30, 0.8, 2, 1.0, 40, 0.0, 0, 0, 0, 0),
    (6, 0.8, 60, 0.0, 70, 0.0, 0, 0, 0, 0), (3, 1.0, 80, 0.0, 60, 0.0, 0, 0, 0, 0),
    (2, 1.0, 60, 0.0, 3, 1.0, 1, 0, 0, 0), (4, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0),
    # furniture by name: long blocks without links are text, all others are not
    (120, 0.0, 90, 0.0, 80, 0.0, 0, 0, 0.5, 1), (150, 0.0, 60, 0.0, 9, 0.0, 0, 0, 0.5, 1),
    (150, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0.5, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.5, 1),
    (300, 0.01, 120, 0.0, 150, 0.0, 0, 1, 0.5, 1), (130, 0.02, 1, 1.0, 90, 0.0, 0, 1, 0.5, 1),
    (1, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0.5, 0), (5, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0.5, 0),
    (14, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0.5, 0), (20, 0.1, 90, 0.0, 0, 0.0, 0, 0, 0.5, 0),
    (40, 0.0, 30, 0.0, 22, 0.0, 0, 0, 0.5, 0), (80, 0.02, 15, 0.0, 12, 0.0, 0, 0, 0.5, 0),
    (150, 0.8, 3, 1.0, 5, 1.0, 0, 0, 0.5, 0), (130, 0.5, 60, 0.0, 70, 0.0, 0, 1, 0.5, 0),
    (4, 0.0, 12, 0.0, 20, 0.0, 1, 0, 0.5, 0), (12, 0.0, 60, 0.0, 60, 0.0, 0, 1, 0.5, 0),
    (30, 0.0, 80, 0.0, 70, 0.0, 0, 1, 0.5, 0), (5, 0.0, 90, 0.0, 20, 0.0, 1, 1, 0.5, 0),
    (60, 0.0, 6, 0.0, 45, 0.0, 0, 1, 0.5, 0), (80, 0.0, 80, 0.0, 120, 0.0, 0, 1, 0.5, 0),
]


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    below: "Node | None" = None
    above: "Node | None" = None
    main: bool = False

    def decide(self, row: Sequence[float]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.below if row[node.feature] < node.cut else node.above
        return node.main


def grow_tree(rows: Sequence[tuple], depth: int = 6, least: int = 1) -> Node:
    """Decision tree by Gini impurity; each row ends with its label."""
    positive = sum(r[-1] for r in rows)
    if depth == 0 or positive in (0, len(rows)):
        return Node(main=2 * positive > len(rows))
    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [r for r in rows if r[feature] < cut], [r for r in rows if r[feature] >= cut]
            if min(map(len, sides)) < least:
                continue
            impurity = sum(sum(r[-1] for r in s) * (1 - sum(r[-1] for r in s) / len(s)) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, cut, sides
    if best is None:
        return Node(main=2 * positive > len(rows))
    _, feature, cut, (below, above) = best
    return Node(feature, cut, grow_tree(below, depth - 1, least), grow_tree(above, depth - 1, least))


def _name_mark(name: str) -> float:
    """How surely a class or another name says furniture: 1, 0.5 where it is ambiguous, or 0.

    What an element only has, lacks or is filed under does not make it furniture; a name of a whole
    layout is ambiguous.
    """
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    found = [i for i, p in enumerate(parts) if p in FURNITURE_NAMES]
    if not found or ABOUT_NAMES & set(parts[:found[0]]):
        return 0.0
    names = {parts[i] for i in found}
    if names == {"widget"} and TEXT_NAMES & set(parts):
        return 0.0
    return 0.5 if names <= AMBIGUOUS_NAMES or LAYOUT_NAMES & set(parts) else 1.0


@lru_cache(maxsize=4096)
def _marked_furniture(tag: str, attributes: str) -> tuple[float, bool]:
    """How surely an element's own tag or attributes mark it as furniture, and whether by name only."""
    if tag in PAGE_TAGS:
        return 0.0, True
    if tag in FURNITURE_TAGS and tag != "form":
        return 1.0, False
    mark = 0.0
    for name, value in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 1.0, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return 1.0, False
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            mark = max([mark, *map(_name_mark, value.split())])
    return mark, True


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    in_article: bool
    in_furniture: float
    form: int = 0  # number of the form that alone marks the block
    wrapped: bool = False  # in an article that lies in an element named as furniture


@dataclass(frozen=True)
class State:
    """What holds inside an open element, from its parent's state and its own tag and names."""

    article: bool = False
    heading: bool = False
    sure: bool = False  # furniture by a tag or hidden
    named: float = 0.0  # by names since the innermost article began
    form: int = 0
    wrapped: bool = False

    def inside(self, tag: str, mark: float, by_name: bool, form: int) -> "State":
        begins = tag in CONTENT_TAGS
        named = 0.0 if begins else self.named
        sure = self.sure or (mark == 1.0 and not by_name)
        return State(
            self.article or begins, self.heading or tag in HEADINGS, sure,
            max(named, mark if by_name else 0.0), form or (0 if begins else self.form),
            self.wrapped or (begins and self.named == 1.0))

    @property
    def furniture(self) -> float:
        if self.sure:
            return 1.0
        return self.named or (0.5 if self.form else 0.0)


def page_blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order. Every open element keeps the state inside it, and open tags
    are counted, so a tag costs the same however deep it lies."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    state, outside = State(), State()
    stack: list[tuple[str, State]] = []
    open_tags: Counter = Counter()
    link = False
    forms = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(
                text, len(text.split()), len(html.unescape(" ".join(linked)).split()), state.heading, state.article,
                state.furniture, state.form if not state.sure and not state.named else 0, state.wrapped))
        parts.clear()
        linked.clear()

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def leave(tag: str) -> State:
        """Close the innermost element of a tag and all inside it."""
        while pop() != tag:
            pass
        return stack[-1][1] if stack else outside

    head = title = False  # the head ends at its end tag or at the first text or tag that it cannot hold
    unclosed: set[str] = set()
    at = 0
    while match := MARKUP.search(page, at):
        piece, at = page[at:match.start()], match.end()
        head = head and (title or not piece.strip())
        if piece and not head:
            parts.append(piece)
            if link:
                linked.append(piece)
        tag = match.group(3)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(match.group(2)), match.group(4)
        if tag in DROPPED:
            if not closing and tag not in unclosed and not (tag == "svg" and attributes.rstrip().endswith("/")):
                if end := DROPPED[tag].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag == "head":
            close()
            head, title = not closing, False
            continue
        if head:
            if tag in HEAD_TAGS:
                title = tag == "title" and not closing
                continue
            if closing and tag not in PAGE_TAGS:
                continue
            head = title = False
        if tag == "a":
            link = not closing
            parts.append("")
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE and not (not closing and attributes and _marked_furniture(tag, attributes.strip())[0]):
            if closing and open_tags[tag]:
                close()
                state = leave(tag)
        else:
            close()
            link = False
            if closing:
                if open_tags[tag]:
                    state = leave(tag)
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or tag in HEADINGS:
                    if stack and stack[-1][0] == tag:
                        pop()  # an unclosed one ends here
                        state = stack[-1][1] if stack else outside
                mark, by_name = _marked_furniture(tag, attributes.strip())
                if tag == "header" and not state.article:
                    mark, by_name = 1.0, False
                forms += tag == "form"
                state = state.inside(tag, mark, by_name, forms if tag == "form" else 0)
                stack.append((tag, state))
                open_tags[tag] += 1
    if at < len(page) and not (head and title):
        parts.append(page[at:])
    close()
    words = Counter()
    for b in blocks:
        words[b.form] += max(b.words - b.linked, 0)
    # An element named as furniture may hold the page's article; beside another article it does not.
    own_article = any(b.in_article and not b.wrapped and not b.in_furniture for b in blocks)
    for b in blocks:
        if b.form and words[b.form] >= FORM_WORDS:
            b.in_furniture = 0.0
        if b.wrapped and own_article:
            b.in_furniture = 1.0
    return blocks


def block_rows(blocks: list[Block]) -> list[tuple]:
    """Feature rows of a page's blocks, in the order of ``FEATURES``."""
    size = [(float(b.words), min(b.linked / max(b.words, 1), 1.0)) for b in blocks]
    edge = (0.0, 0.0)
    return [(*size[i], *(size[i - 1] if i else edge), *(size[i + 1] if i + 1 < len(size) else edge),
             float(b.heading), float(b.in_article), float(b.in_furniture)) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree: Node) -> str:
    blocks = page_blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(blocks, block_rows(blocks)) if tree.decide(row))


def extract_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), source: str = "html",
                 examples: Sequence[tuple] = EXAMPLES) -> DataFrame:
    """The ``keep`` columns with ``text`` and ``n_chars`` (its code points) of every page."""
    bounded_batches(pages.sparkSession)
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    tree = grow_tree(examples)

    def run(batches):
        for part in text_slices(batches, "_html"):
            texts = [main_text(p, tree).encode("utf-8", "replace").decode() for p in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f"_k{i}") for i in range(len(keep))], pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    return pages.select(*named, F.col(source).alias("_html")).mapInArrow(run, schema)
