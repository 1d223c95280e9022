"""Operator 1: main text of web pages by tree scoring.

A page is parsed into a tree with the usual repairs (unclosed p, li, td..., stray end tags, raw text of
script and style). Each paragraph (p, pre, td, blockquote, and the text of a div or section without any block in it, as if it stood in a paragraph there) of 25 characters or more passes points to its ancestors: 1, one more for each
comma and one for every 100 characters up to 3; all of them to its parent, half to its grandparent, a
third of that per level to the next three. A container starts with points for its tag and for telling words in class and id;
its score is multiplied by 1 - link density (the share of its text that lies in links). The best
container is kept, and of its siblings those with at least a fifth of its score, or paragraphs of long
text with few links.

The result has one row for each input row. Nulls and ties: a null page gives null text and title; an empty one, or one
without any text, gives ``""``. Of containers with equal scores the first in the document wins. A page without a single
scoring paragraph gives the text of its body without navigation, headers, footers, asides and forms.
Repeated rows are repeated in the result. Null ids stay, and ids are integers (or text that reads as integers); other columns are ignored. No page is cut off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("script style noscript template head iframe svg button select option object".split())
_BARE = frozenset("nav header footer aside form menu".split())
#: An opening tag closes an open one of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_SCOPE = frozenset("table ul ol dl div article section body html td th blockquote aside main".split())
_TAG_POINTS = {"div": 5, "article": 8, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "nav": -25, "footer": -25, "aside": -25, "header": -10}
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\b(?:ad|ads)\b|advert|banner|comment|combx|contact|footer|footnote|masthead|menu|meta|nav|promo|related|scroll|share|sidebar|sponsor|tags|widget", re.I)
_SPACE = re.compile(r"\s+")
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote"))
#: The text of one of these without any block in it counts as a paragraph within it.
_CONTAINER = frozenset(("div", "section", "article", "main", "center"))


class Node:
    __slots__ = ("tag", "parent", "children", "words", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, words: str = ""):
        self.tag, self.parent, self.words = tag, parent, words
        self.children: list[Node | str] = []
        self.score: float | None = None
        self.chars = self.linked = 0


def parse(page: str) -> tuple[Node, str]:
    """The tree of a page, and its title."""
    root = node = Node("html", None)
    title, at, n, last = "", 0, len(page), page.rfind(">")
    while at < n:
        m = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag == "html":
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if tag == "title" and not title:
                title = _SPACE.sub(" ", html.unescape(page[at : end.start() if end else n])).strip()
            elif tag == "textarea":
                node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if tag in _VOID:
            node.children.append("\n" if tag in ("br", "hr") else "")
            continue
        shut = _CLOSES.get(tag)
        if shut:
            up = node
            while up is not root and up.tag not in shut and (up.tag not in _SCOPE or tag == "tr"):
                up = up.parent
            if up is not root and up.tag in shut:
                node = up.parent
        rest = m.group(3)
        words = " ".join(next(filter(None, x.groups()[1:]), "") for x in _ATTR.finditer(rest)) if "=" in rest else ""
        new = Node(tag, node, words)
        node.children.append(new)
        if not rest.endswith("/"):
            node = new
    return root, title


def _measured(root: Node) -> list[Node]:
    """All nodes in document order, with the characters of their text and of their links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in _SKIP)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.linked += c.linked
        if node.tag == "a":
            node.linked = node.chars
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def text_of(node: Node, bare: bool = False) -> str:
    """The text, one line for each block."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x if x == "\n" else _SPACE.sub(" ", html.unescape(x)))
        elif x.tag not in _SKIP and not (bare and x.tag in _BARE):
            block = x.tag in _BLOCK
            if block:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.children))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def _start(node: Node) -> float:
    points = float(_TAG_POINTS.get(node.tag, 0))
    if node.words:
        points += 25.0 * bool(_GOOD.search(node.words)) - 25.0 * bool(_BAD.search(node.words))
    return points


def extract(page: str) -> tuple[str, str, float, float]:
    """``(title, text, score of the best container, its link density)``."""
    root, title = parse(page)
    order = _measured(root)
    scored = []
    for node in order:
        if (node.tag not in _PARAGRAPH and node.tag not in _CONTAINER) or node.chars < 20 or any(isinstance(c, Node) and c.tag in _BLOCK for c in node.children):
            continue
        text = text_of(node)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        up, level = node if node.tag in _CONTAINER else node.parent, 0
        while up is not None and level < 5:
            if up.score is None:
                up.score = _start(up)
                scored.append(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    place = {id(n): i for i, n in enumerate(order)}
    scored.sort(key=lambda n: place[id(n)])
    best, top = None, 0.0
    for node in scored:
        final = node.score * (1 - _density(node))
        if best is None or final > top:
            best, top = node, final
    if best is None:
        return title, text_of(root, True), 0.0, 0.0
    if best.parent is None:
        return title, text_of(best, True), top, _density(best)
    chosen = []
    for other in best.parent.children:
        if other is best:
            chosen.append(text_of(best))
        elif isinstance(other, Node) and other.tag not in _SKIP and other.chars:
            bonus = 0.2 * top if other.words and other.words == best.words else 0.0
            d = _density(other)
            if other.score is not None and other.score * (1 - d) + bonus >= max(10.0, 0.2 * top):
                chosen.append(text_of(other))
            elif other.tag == "p" and ((other.chars > 80 and d < 0.25) or (0 < other.chars <= 80 and d == 0 and re.search(r"[.!?](?:\s|$)", text_of(other)))):
                chosen.append(text_of(other))
    return title, "\n".join(x for x in chosen if x), top, _density(best)


_OUT = "page_id long, url string, title string, text string, score double, link_density double"


def _extracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            found = [(None,) * 4 if x is None else extract(x) for x in some.column("html").to_pylist()]
            cols = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), *cols], names=["page_id", "url", "title", "text", "score", "link_density"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, title, text, score, link_density)`` of every page."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(_extracted, _OUT)
