"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, fewer from level to level; a container's points are discounted by the share of its
text that is links. The container with most points is the article (or what encloses it, if the page marks that as one), together
with siblings that read like it. Parts that are no article by their element, role or class take no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm.tables import documents_of

# Element names of HTML and the words pages use for what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li"
    " main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNWANTED = frozenset("nav footer aside form button dialog menu head label fieldset select datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar ad ads adv advert adverts advertisement advertising"
    " adbox adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing"
    " social related recommended comment comments commentlist disqus respond reply replies discussion subscribe subscription newsletter signup login register"
    " pagination pager toolbar widget search".split()
)
# Beside those words in a name they say nothing: comment-list, share-box. Other words do: related-work is a part of the article.
FILLERS = frozenset("area bar block body box button buttons container content form group inner item items left link links list main right row section thread top bottom wrap wrapper".split())
# Inside an article a part may be named so for what it is about.
TOPICS = frozenset("alert discussion notice notices notification promotion register registration related response search social".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th article section div body main".split())
SCORED = frozenset("p pre td blockquote li dd".split())
NEVER_BY_CLASS = frozenset("html body article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*|[^>]*)(?:>|\Z)", re.S
)
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
LEAST_LENGTH = 25


class _Element:
    __slots__ = ("tag", "parent", "kids", "wanted", "in_article", "block", "open", "given", "later", "length", "linked")

    def __init__(self, tag: str, parent: _Element | None, wanted: bool):
        self.tag, self.parent, self.wanted = tag, parent, wanted
        self.kids: list[_Element | str] = []
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        # the block it stands in or is, and how many elements of each inline tag are open there
        self.block: _Element = self if parent is None or tag in BLOCKS else parent.block
        self.open: dict[str, int] = {}
        self.given, self.later, self.length, self.linked = 0.0, 0.0, 0, 0

    @property
    def points(self) -> float:
        return self.given + self.later


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in UNWANTED or tag == "header" and not in_article:
        return True
    if not attributes or tag in NEVER_BY_CLASS:
        return False
    for name, *values in _MARKS.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(_names_no_article(token, tag, name, in_article) for token in value.split()):
            return True
    return False


def _names_no_article(token: str, tag: str, attribute: str, in_article: bool) -> bool:
    """Whether one class or id says that its element is no article. Inside an article all of it must say so, and an id or a section
    may be named for its topic."""
    words = {w for w in re.split(r"[^a-z]+", token) if w}
    if not in_article:
        return bool(words & WORDS)
    signs = words & WORDS - {"header"}
    if attribute == "id" or tag == "section":
        signs -= TOPICS
    return bool(signs) and words <= WORDS | FILLERS


def parse(page: str) -> _Element:
    """The tree of a page; tags that are missing are put in where browsers do so, and what follows the last `<` of a page that
    was cut off inside a tag is dropped."""
    root = _Element("html", None, True)
    here, at, end, met = root, 0, len(page), set()
    open_blocks: Counter[str] = Counter()

    def close_to(node: _Element) -> None:
        """Close what is open below node."""
        nonlocal here
        while here is not node:
            if here.tag in BLOCKS:
                open_blocks[here.tag] -= 1
            else:
                here.block.open[here.tag] -= 1
            here = here.parent

    while at < end:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else end]
        if text:
            here.kids.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            # an end tag without its start tag costs nothing, however deep the place
            if open_blocks[tag] > 0 if tag in BLOCKS else here.block.open.get(tag, 0) > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                close_to(node.parent)
            continue
        if tag == "html" or tag == "body" and tag in met:
            continue
        met.add(tag)
        closes = {"p"} if tag in BLOCKS else set()
        closes |= CLOSED_BY.get(tag, set())
        if any(open_blocks[c] > 0 if c in BLOCKS else here.block.open.get(c, 0) > 0 for c in closes):
            node, upto = here, here
            while node is not root and node.tag not in (SCOPES - closes):
                if node.tag in closes:
                    upto = node.parent
                node = node.parent
            close_to(upto)
        element = _Element(tag, here, not _unwanted(tag, found[3], here.in_article))
        here.kids.append(element)
        if tag in RAW:
            element.wanted = False
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            here = element
            if tag in BLOCKS:
                open_blocks[tag] += 1
            else:
                element.block.open[tag] = element.block.open.get(tag, 0) + 1
    return root


def _measure(root: _Element) -> list[_Element]:
    """Lengths and points of all wanted elements; returns those that got points, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, _Element) and k.wanted]
    for node in reversed(order):
        own = "".join(k for k in node.kids if isinstance(k, str))
        below = [k for k in node.kids if isinstance(k, _Element) and k.wanted]
        node.length = len(own.strip()) + sum(k.length for k in below)
        node.linked = node.length if node.tag == "a" else sum(k.linked for k in below)
        if node.length >= LEAST_LENGTH and (node.tag in SCORED or len(own.strip()) >= LEAST_LENGTH and node.tag in ("div", "section", "article", "main", "body")):
            points = (1 + own.count(",") + min(node.length / 100, 3.0)) * (1 - node.linked / node.length)
            up = node if node.tag not in SCORED else node.parent
            if up is not None:
                up.given += points
    for node in reversed(order):  # half to the next one up, and of what came from below, a third goes on
        if node.parent is not None:
            node.parent.later += 0.5 * node.given + node.later / 3
    return [n for n in order if n.points > 0]


def _density(node: _Element) -> float:
    return node.linked / node.length if node.length else 0.0


def _article(root: _Element) -> list[_Element]:
    """The best container with siblings that belong to it, in page order."""
    scored = _measure(root)
    if not scored:
        return [root]
    best = max(scored, key=lambda n: n.points * (1 - _density(n)))
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    best = node or best
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * best.points)
    kept = []
    for k in best.parent.kids:
        if not isinstance(k, _Element) or not k.wanted:
            continue
        reads = k.tag == "p" and k.length >= 80 and _density(k) < 0.25
        if k is best or k.points * (1 - _density(k)) >= least or reads or k.tag == "h1" and _density(k) == 0:
            kept.append(k)
    return kept


def _menus(part: _Element) -> list[_Element]:
    """Lists and boxes of links with which a container that the page does not mark as article begins or ends."""
    kids = [k for k in part.kids if isinstance(k, _Element) and k.wanted and k.length or isinstance(k, str) and k.strip()]
    out = []
    for side in (kids, kids[::-1]):
        for k in side:
            if not isinstance(k, _Element) or k.tag not in ("ul", "ol", "div", "table", "section") or _density(k) <= 0.5:
                break
            out.append(k)
    return out


def _blocks(parts: list[_Element]) -> list[str]:
    out, run = [], []

    def close():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    menus = {id(m) for part in parts if not part.in_article for m in _menus(part)}
    stack: list[_Element | str | None] = list(reversed(parts))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif item.wanted:
            if id(item) in menus:
                continue
            if item.tag in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(item.kids)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line; empty for a page without text."""
    return "\n".join(_blocks(_article(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are ignored).

    A null or empty page, or one without an article, gives an empty text. Rows with equal page_id, null included, are rows of their
    own; an empty table gives no rows. Pages are taken whole; unclosed tags are closed as browsers do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    pages = documents_of(pages, "page_id", "url", "html")
    return pages.mapInArrow(rows, "page_id long, url string, text string, n_chars long") if dict(pages.dtypes)["page_id"] == "bigint" else extract(
        pages.selectExpr("cast(page_id as long) as page_id", "url", "html"))
