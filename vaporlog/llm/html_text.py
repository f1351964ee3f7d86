"""Main text of web pages by composite text density.

A page becomes a tree of block elements. Every node gets its characters per tag, adjusted for link text; the
node whose children's densities have the largest sum holds the main text, and the smallest density on its path
to the body is the threshold for other parts. Boilerplate elements are cut off before.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vaporlog.llm.common import text_of, with_library

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block; a tag of any other kind ends it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img picture".split()
)
#: Never main text.
BOILERPLATE = frozenset("nav footer aside form button select option dialog menu head object canvas audio video map".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent notice notices alert popup modal comment "
    "comments respond disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "search pagination pager toolbar widget copyright skip".split()
)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """A block element: its children and texts in page order."""

    __slots__ = ("tag", "items", "parent", "dropped", "chars", "link_chars", "tags", "link_tags", "density", "total", "keep")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped, self.keep = tag, parent, dropped, False
        self.items: list = []


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements end with their parents, and a paragraph at the next block."""
    root = node = Node("body", None, False)
    links = 0
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            node.items.append((page[at:stop], links > 0))
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                open_ = node
                while open_.parent is not None and open_.tag != tag:
                    open_ = open_.parent
                if open_.parent is not None:
                    node, links = open_.parent, 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                node.items.append((" ", False))
            continue
        if tag in ("html", "body"):
            while node.parent is not None:
                node = node.parent
            continue
        while node.parent is not None and (node.tag == "p" or node.tag == tag and tag in ("li", "option", "tr", "td", "th", "dt", "dd")):
            node = node.parent
        links = 0
        child = Node(tag, node, _boilerplate(tag, found[3], node))
        node.items.append(child)
        if tag not in VOID and not found[3].endswith("/"):
            node = child
    return root


def _boilerplate(tag: str, attributes: str, parent: Node) -> bool:
    if tag in BOILERPLATE:
        return True
    if tag == "header":
        above = parent
        while above is not None and above.tag not in ("article", "main"):
            above = above.parent
        return above is None
    if tag in ("article", "main") or not attributes:
        return False
    for _, *values in _ATTRIBUTE.findall(attributes):
        if not MARKS.isdisjoint(_SPLIT.split("".join(values).lower())):
            return True
    return False


def _measure(root: Node) -> list[Node]:
    """Characters and tags of every node, children first; nodes cut off count nothing."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [x for x in node.items if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for item in node.items:
            if isinstance(item, Node):
                if not item.dropped:
                    node.chars += item.chars
                    node.link_chars += item.link_chars
                    node.tags += item.tags + 1
                    node.link_tags += item.link_tags
            else:
                size = len(item[0].strip())
                node.chars += size
                if item[1]:
                    node.link_chars += size
                    node.link_tags += 1
    page_links = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + page_links * c + math.e)
            ratio = c / max(1, lc) * t / lt
            node.density = c / t * (math.log(max(ratio, 1.0) + 1) / math.log(max(base, math.e)))
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.dropped) or node.density
    return order


def main_text(page: str) -> str:
    """The main text: white space inside a block is one space, blocks are joined by one space."""
    root = parse(page)
    order = _measure(root)
    best = max(order, key=lambda node: node.total)
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    top: dict[int, Node] = {}
    for node in reversed(order):  # the best node at or below each
        below = [top[id(x)] for x in node.items if isinstance(x, Node) and not x.dropped]
        top[id(node)] = max([node, *below], key=lambda x: x.total)
    for node in order:
        if node.density >= threshold and node.chars:
            chosen = article = top[id(node)]
            while article is not None:
                if article.tag in ("article", "main"):
                    chosen = article
                article = article.parent
            chosen.keep = True
    blocks: list[str] = []
    _gather(root, blocks)
    return " ".join(blocks)


def _gather(root: Node, blocks: list[str]) -> None:
    """Texts of kept nodes in page order, one entry per block."""
    waiting: list = [(root, root.keep)]
    run: list[str] = []

    def close() -> None:
        words = html.unescape("".join(run)).split()
        run.clear()
        if words:
            blocks.append(" ".join(words))

    while waiting:
        item, kept = waiting.pop()
        if item is None:
            close()
        elif isinstance(item, Node):
            close()
            if not item.dropped:
                kept = kept or item.keep
                waiting.append((None, False))
                waiting += [(x, kept) for x in reversed(item.items)]
        elif kept:
            run.append(item[0])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null html is empty and gives empty text; a null url stays null; repeated rows give repeated rows;
    other columns are ignored; an empty table gives no rows.
    """
    with_library(pages.sparkSession)
    rows = pages.select(
        pages[id_column].alias("page_id"), pages[url_column].cast("string").alias("url"), text_of(pages, html_column).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
