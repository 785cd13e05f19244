"""Main text of web pages: flat text blocks classified by a decision tree over their neighbourhood.

A page is read once from left to right into flat text blocks: the text between two block-level tags, inline
markup dropped. A block has a word count and a link density (share of its words inside ``a``) and knows those of
the block before and after it; it also knows whether it stands in a heading and what its innermost telling ancestor
says: an article or main part, or a part that page furniture lives in (menus, headers, footers, sidebars, notices,
adverts, forms, comments: by tag, role, or a word of class or id). Where the marked article holds most of the words outside
furniture, what stands outside it counts as furniture. A small binary decision tree (Gini) over these
features, trained on the labelled table ``LABELLED``, says which blocks are main text.

Scripts, styles, comments, markup and the document's head never become text. Character references are
decoded, white space in a block becomes one blank, blocks are joined in page order by an empty line. Tags may be
unclosed, unopened, wrongly nested or cut off at the page's end: an end tag closes up to its nearest open
element and is ignored without one.

Each page is read where its row is: no shuffle, memory as for the longest page.

Defined cases: a null or empty page, or one without a main block, gives an empty text; very long pages are read whole;
rows without an id or url and repeated rows get a row each; equal blocks of a page all count; in the tree's training the first feature
and the lowest threshold win a tie; an empty table gives an empty result; columns other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import common as C

# --- fixed values ----------------------------------------------------------------------------
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select button".split())  #: dropped with their content
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
ARTICLE_TAGS = frozenset("article main".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification outbrain "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe taboola teaser toolbar topbar tracking widget widgets".split())
ARTICLE_WORDS = frozenset("article articlebody content entry maincontent post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: words, link density in %; the same of the block before and after; place (-1 furniture, 0 unknown, 1 article); heading; main text?
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading")
LABELLED = [
    # in page furniture: never main text
    (1, 100, 0, 0, 1, 100, -1, 0, 0), (2, 100, 1, 100, 2, 100, -1, 0, 0), (9, 0, 1, 100, 8, 0, -1, 0, 0), (12, 0, 6, 100, 5, 0, -1, 0, 0),
    (60, 0, 3, 0, 40, 0, -1, 0, 0), (150, 0, 80, 0, 0, 0, -1, 0, 0), (25, 10, 120, 0, 0, 0, -1, 0, 0), (4, 0, 200, 0, 30, 0, -1, 1, 0),
    (35, 0, 4, 0, 50, 0, -1, 0, 0), (8, 50, 90, 0, 6, 60, -1, 0, 0),
    # in an article: main text, long or short
    (6, 0, 12, 0, 40, 0, 1, 1, 1), (1, 0, 1, 100, 90, 0, 1, 1, 1), (40, 0, 6, 0, 90, 0, 1, 0, 1), (2, 0, 70, 0, 55, 0, 1, 0, 1),
    (1, 0, 3, 0, 9, 0, 1, 0, 1), (120, 3, 40, 0, 80, 0, 1, 0, 1), (90, 0, 120, 3, 9, 0, 1, 0, 1), (15, 20, 60, 0, 45, 0, 1, 0, 1),
    (8, 0, 100, 0, 12, 5, 1, 0, 1), (25, 40, 30, 0, 60, 0, 1, 0, 1), (5, 0, 80, 0, 70, 0, 1, 1, 1), (3, 100, 9, 0, 60, 0, 1, 1, 1),
    (45, 0, 0, 0, 0, 0, 1, 0, 1), (1, 0, 0, 0, 0, 0, 1, 0, 1), (10, 0, 2, 100, 3, 100, 1, 0, 1),
    # in an article: lists of links
    (3, 100, 80, 0, 3, 100, 1, 0, 0), (6, 100, 3, 100, 5, 100, 1, 0, 0), (5, 100, 6, 100, 9, 0, 1, 0, 0), (9, 90, 5, 100, 12, 0, 1, 0, 0),
    (4, 100, 60, 0, 50, 0, 1, 0, 0), (7, 80, 4, 100, 8, 75, 1, 0, 0),
    # place unknown: long blocks with few links
    (40, 0, 5, 0, 70, 0, 0, 0, 1), (70, 4, 40, 0, 35, 0, 0, 0, 1), (35, 0, 70, 4, 6, 0, 0, 0, 1), (120, 10, 3, 100, 90, 0, 0, 0, 1),
    (200, 0, 2, 100, 4, 50, 0, 0, 1), (30, 5, 45, 0, 25, 0, 0, 0, 1), (50, 20, 60, 10, 40, 5, 0, 0, 1), (25, 0, 30, 0, 12, 100, 0, 0, 1),
    (90, 0, 0, 0, 0, 0, 0, 0, 1), (26, 0, 2, 100, 3, 100, 0, 0, 1),
    # place unknown: short blocks beside long ones, headings before text
    (6, 0, 2, 100, 60, 0, 0, 1, 1), (4, 0, 80, 0, 70, 0, 0, 1, 1), (8, 0, 3, 100, 90, 0, 0, 1, 1), (12, 0, 45, 0, 50, 0, 0, 0, 1),
    (3, 0, 60, 0, 40, 0, 0, 0, 1), (14, 0, 70, 0, 30, 5, 0, 0, 1), (9, 0, 33, 0, 28, 0, 0, 0, 1),
    # place unknown: menus, lists of links, short blocks among short ones, notes at the page's ends
    (1, 100, 0, 0, 2, 100, 0, 0, 0), (2, 100, 2, 100, 1, 100, 0, 0, 0), (5, 100, 2, 100, 30, 0, 0, 0, 0), (12, 100, 10, 100, 14, 100, 0, 0, 0),
    (40, 80, 5, 100, 6, 100, 0, 0, 0), (30, 60, 12, 70, 3, 100, 0, 0, 0), (8, 0, 70, 0, 0, 0, 0, 0, 0), (6, 0, 3, 100, 4, 100, 0, 0, 0),
    (4, 0, 5, 0, 6, 0, 0, 0, 0), (10, 10, 40, 0, 3, 100, 0, 0, 0), (9, 0, 2, 100, 8, 0, 0, 0, 0), (3, 0, 0, 0, 2, 100, 0, 0, 0),
    (7, 50, 60, 0, 20, 0, 0, 0, 0), (4, 0, 5, 100, 6, 100, 0, 1, 0), (5, 0, 40, 0, 4, 100, 0, 1, 0), (14, 70, 90, 0, 80, 0, 0, 0, 0),
]


# --- decision tree ---------------------------------------------------------------------------
@dataclass
class Node:
    """A leaf has a verdict; an inner node sends rows with feature <= threshold to ``low``."""

    verdict: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _gini(y: np.ndarray) -> float:
    share = y.mean()
    return 2 * share * (1 - share)


def train(table: list[tuple] = LABELLED, depth: int = 8, least: int = 1) -> Node:
    """Binary tree of the best Gini splits; thresholds lie midway between neighbouring values."""
    data = np.array(table, float)

    def grow(rows: np.ndarray, left: int) -> Node:
        x, y = rows[:, :-1], rows[:, -1]
        node = Node(bool(2 * y.sum() > len(y)))
        if left == 0 or _gini(y) == 0:
            return node
        best = _gini(y) - 1e-12
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                n = int(low.sum())
                cost = (n * _gini(y[low]) + (len(y) - n) * _gini(y[~low])) / len(y)
                if min(n, len(y) - n) >= least and cost < best - 1e-12:
                    best, node.feature, node.threshold = cost, f, float(t)
        if node.feature >= 0:
            low = x[:, node.feature] <= node.threshold
            node.low, node.high = grow(rows[low], left - 1), grow(rows[~low], left - 1)
        return node

    return grow(data, depth)


def decide(node: Node, features: tuple) -> bool:
    while node.low is not None:
        node = node.low if features[node.feature] <= node.threshold else node.high
    return node.verdict


# --- flat text blocks ------------------------------------------------------------------------
_TAG = re.compile(r"""<(?:(!--)|(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>|([!?/])[^>]*>)""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
_CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_TELLING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop|aria-hidden)\b", re.I)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int
    heading: bool

    @property
    def density(self) -> float:
        return 100 * self.linked / self.words


def place_of(tag: str, attributes: str, outer: int) -> int:
    """What an element says of its content: -1 furniture, 1 article, 0 nothing."""
    if tag in ("html", "body"):
        return 0
    if tag in FURNITURE_TAGS or (tag == "header" and outer != 1):
        return -1
    found = 1 if tag in ARTICLE_TAGS else 0
    if not _TELLING.search(attributes):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return -1
        if name == "role":
            if value.lower() in FURNITURE_ROLES:
                return -1
            found = 1 if value.lower() in ("main", "article") else found
        if name in ("class", "id", "itemprop"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & FURNITURE_WORDS or ({"header"} & words and outer != 1 and not words & ARTICLE_WORDS):
                return -1
            found = 1 if words & ARTICLE_WORDS else found
    return found


@dataclass
class Reader:
    """State while a page is read: open elements with the place each one sets, and the block under way."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int]] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    in_link: bool = False

    def place(self) -> int:
        return next((p for _, p in reversed(self.stack) if p), 0)

    def flush(self) -> None:
        parts, self.parts = self.parts, []
        text = " ".join(markup.unescape("".join(t for t, _ in parts)).split())
        if not text:
            return
        words = len(text.split(" "))
        linked = len(markup.unescape(" ".join(t for t, link in parts if link)).split()) if any(link for _, link in parts) else 0
        self.blocks.append(Block(text, words, min(linked, words), self.place(), bool(self.stack) and self.stack[-1][0] in HEADINGS))

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = True
            elif tag == "br":
                self.parts.append((" ", False))
            elif (place := place_of(tag, attributes, self.place())) == -1:
                self.flush()
                self.stack.append((tag, place))
            return
        self.flush()
        self.in_link = False  # an unclosed link ends with its block
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # closed by the next one
            self.end_implied(tag, ("p",) if tag == "p" else ("li", "p"))
        self.stack.append((tag, place_of(tag, attributes, self.place())))

    def end_implied(self, tag: str, closes: tuple[str, ...]) -> None:
        while self.stack and self.stack[-1][0] in closes:
            self.stack.pop()

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), -1)
        if tag not in INLINE or at >= 0:
            self.flush()
        if at >= 0:
            del self.stack[at:]


def text_blocks(page: str) -> list[Block]:
    """Flat text blocks in page order."""
    reader, at, n = Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            reader.parts.append((page[at:lt], reader.in_link))
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if m is None:  # a lone < is text
            reader.parts.append(("<", reader.in_link))
            at = lt + 1
            continue
        at = m.end()
        if m.re is _TAG and m[1]:
            closed = page.find("-->", lt + 2)
            at = n if closed < 0 else closed + 3
            continue
        end, tag, attributes = (m[2], m[3], m[4]) if m.re is _TAG else (m[1], m[2], m[3])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            reader.end(tag)
        elif tag in RAW:
            if attributes.endswith("/") and tag in ("svg", "math", "object", "iframe"):
                continue
            m = _CLOSING[tag].search(page, at)
            at = n if m is None else m.end()
        else:
            reader.start(tag, attributes)
    reader.flush()
    return reader.blocks


def main_text(page: str, tree: Node) -> str:
    """Blocks that the tree calls main text, joined by an empty line."""
    blocks = text_blocks(page)
    inside = sum(b.words for b in blocks if b.place == 1)
    elsewhere = -1 if inside > sum(b.words for b in blocks if b.place == 0) else 0
    sizes = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    kept = [b.text for i, b in enumerate(blocks, 1)
            if decide(tree, (*sizes[i], *sizes[i - 1], *sizes[i + 1], b.place or elsewhere, b.heading))]
    return "\n\n".join(kept)


def extract(pages: DataFrame, table: list[tuple] = LABELLED) -> DataFrame:
    """Main text of every page. No shuffle."""
    tree = train(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in C.slices(b, "html"):
                texts = [main_text(h, tree) if h else "" for h in s.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column("page_id"), s.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return (pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
