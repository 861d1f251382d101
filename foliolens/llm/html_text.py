"""Main text of web pages by composite text density.

A page is parsed to a tree. What holds no text of the page (scripts, styles, form controls, embedded objects)
and what HTML itself sets apart from the content (nav, aside, footer, form, a header outside of articles, and
elements with such a role, or hidden) is not in it. For each node: C characters, T tags, LC characters in links, LT
links, all of its subtree. Its density is C/T, times a logarithm of C*T/(LC*LT) whose
base grows with the share of links, so text without links scores high. Characters of an element whose class or id
says as a whole that it is an advert, a menu or the like count as if they were in a link. The node with the largest
sum of its children's densities is the content; the least density on the path from it to
body is the threshold, and other subtrees that reach it give their own node with the
largest sum. If the content lies in an article or main element, all of it is taken, but for parts
that are wholly such an element.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import small_batches, table
from foliolens.sources.files import spread

_VOID = frozenset(("area", "base", "basefont", "bgsound", "br", "col", "embed", "frame", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"))
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"))
_BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
#: No text of the page: never in the tree.
_NO_TEXT = frozenset(("head", "script", "style", "noscript", "template", "iframe", "object", "embed", "applet", "button", "select", "textarea", "input", "svg", "math", "canvas", "audio", "video", "map", "title", "noembed", "noframes", "xmp"))
#: Set apart from the content by HTML itself.
_APART = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"))
#: A class or id that is one of these as a whole marks an element's characters as those of a link.
NAMES = frozenset(("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "cookie-banner", "cookie-notice", "footer", "menu", "nav", "navbar", "newsletter", "notice", "pagination", "popup", "promo", "related", "share", "sidebar", "social", "sponsored", "subscribe", "widget"))
_KEEP = frozenset(("html", "body", "article", "main"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
#: Start tags that end an open element of the second kind, up to an element of the third.
_P_ENDS = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary"}
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
_SCOPE = frozenset(("html", "body", "td", "th", "table", "article", "section", "main", "div", "nav", "aside", "header", "footer", "form", "blockquote", "button", "fieldset", "figure", "li", "dd", "dt"))


def _said(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(is it left out, does it name itself as no content)"""
    if tag in _NO_TEXT or tag in _APART or tag == "header" and not in_article:
        return True, True
    named = False
    if attributes and tag not in _KEEP:
        for name, a, b, c in _ATTR.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, True
            named |= name in ("class", "id") and not NAMES.isdisjoint(value.split())
    return False, named


class _Tree:
    """Nodes as parallel lists; a node's number is over its parent's. Text is (node, block, string)."""

    __slots__ = ("parent", "tag", "gone", "named", "texts", "block")

    def __init__(self) -> None:
        self.parent, self.tag, self.gone, self.named, self.texts, self.block = [-1], ["#root"], [False], [False], [], 0


class _Open:
    """The open elements, with the places of each tag, so that no search depends on how deep they nest."""

    def __init__(self, tree: _Tree) -> None:
        self.tree, self.stack, self.places, self.scopes = tree, [0], {}, []

    def push(self, node: int) -> None:
        tag = self.tree.tag[node]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.tree.tag[self.stack.pop()]
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            self.tree.block += tag in _BLOCK

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that tag; 0 if there is none."""
        return (self.places.get(tag) or (0,))[-1]

    def first_after(self, tag: str, place: int) -> int:
        """The place of the outermost one beyond place; 0 if there is none."""
        own = self.places.get(tag) or ()
        k = bisect_right(own, place)
        return own[k] if k < len(own) else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def _parse(page: str) -> _Tree:
    t = _Tree()
    o = _Open(t)
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b and not t.gone[o.stack[-1]]:
            t.texts.append((o.stack[-1], t.block, page[a:b]))

    def space() -> None:
        if not t.gone[o.stack[-1]]:
            t.texts.append((o.stack[-1], t.block, " "))

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        place = o.last(tag)
        if tag == "br":
            space()
            continue
        if m[1]:
            if place and (tag in _BLOCK or place >= o.scope()):  # an inline end tag does not close the block around it
                o.pop_to(place)
            elif tag == "p" and not place:
                t.block += 1
            continue
        if tag in _P_ENDS and o.last("p") > o.scope():
            o.pop_to(o.last("p"))
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            stop = max(o.last(x) for x in stops)
            if begins := [k for x in ends if (k := o.first_after(x, stop))]:
                o.pop_to(min(begins))
        if tag in ("html", "body") and place:
            continue
        if tag == "body":  # an open head ends where body begins
            o.pop_to(o.last("html") + 1)
        apart, named = _said(tag, m[3], o.last("article") > 0)
        up = o.stack[-1]
        t.parent.append(up)
        t.tag.append(tag)
        t.gone.append(t.gone[up] or apart)
        t.named.append(t.named[up] or named)
        t.block += tag in _BLOCK
        if tag in _VOID:
            continue
        if tag in _RAW:
            if tag in _NO_MARKUP:
                close = _NO_MARKUP[tag].search(page, at)
                at = close.end() if close else n
                continue
            if m[3].rstrip().endswith("/"):
                continue
        o.push(len(t.tag) - 1)
    text(at, n)
    return t


#: Elements whose text is no markup, and what ends them.
_NO_MARKUP = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


def node_densities(parent, tag, gone, named, own_chars) -> tuple[list[float], list[int]]:
    """(density, characters) of each node; own_chars: characters of the text that stands in it directly."""
    size = len(tag)
    chars, tags, links, link_chars = list(own_chars), [0] * size, [0] * size, [0] * size
    in_link = [False] * size
    for k in range(1, size):
        in_link[k] = in_link[parent[k]] or named[k] or tag[k] == "a"
    for k in range(size):
        link_chars[k] = chars[k] if in_link[k] else 0
    for k in range(size - 1, 0, -1):
        if gone[k]:
            continue
        p = parent[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        tags[p] += tags[k] + 1
        links[p] += links[k] + (tag[k] == "a")
    body = body_of(tag, gone, chars)
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * size
    for k in range(size):
        c = chars[k]
        if gone[k] or not c:
            continue
        n, lc, lt = max(1, tags[k]), max(1, link_chars[k]), max(1, links[k])
        base = math.log(c / max(1, c - link_chars[k]) * link_chars[k] + share * c + math.e)
        density[k] = 0.0 if lc >= c > 1 else c / n * max(0.0, math.log(c / lc * n / lt)) / base
    return density, chars


def body_of(tag, gone, chars) -> int:
    body = next((k for k in range(len(tag)) if tag[k] == "body" and not gone[k]), 0)
    return body if chars[body] else 0


def selected(t: _Tree, density: list[float], chars: list[int]) -> list[bool]:
    """Which nodes are content: the subtree with the largest sum, and others that reach the threshold of its path."""
    size, parent, tag, gone = len(t.tag), t.parent, t.tag, t.gone
    body = body_of(tag, gone, chars)
    total = [0.0] * size
    for k in range(1, size):
        total[parent[k]] += density[k]
    for k in range(size):
        if not total[k] and density[k]:
            total[k] = density[k] * 1e-9  # a node with text but no child elements
    below = [False] * size  # within body
    below[body] = True
    for k in range(body + 1, size):
        below[k] = parent[k] >= body and below[parent[k]]
    inside = [k for k in range(size) if below[k] and not gone[k]]
    target = max(inside, key=lambda k: (total[k], -k))
    up = target
    while up > body and tag[up] not in ("article", "main"):
        up = parent[up]
    if tag[up] in ("article", "main"):
        target = up
    threshold, k = density[target], target
    while k != body and k > 0:
        k = parent[k]
        threshold = min(threshold, density[k])
    # Every subtree that reaches the threshold gives its node with the largest sum.
    best = list(range(size))
    for k in range(size - 1, 0, -1):
        p = parent[k]
        if below[k] and not gone[k] and (total[best[k]], -best[k]) > (total[best[p]], -best[p]):
            best[p] = best[k]
    marked = [False] * size
    marked[target] = True
    passes = [False] * size
    for k in inside:
        if (k == body or passes[parent[k]]) and density[k] >= threshold - 1e-9:
            passes[k] = True
            if not total[target] or total[best[k]] > 0:
                marked[best[k]] = True
    kept = [False] * size
    for k in range(size):
        whole = t.named[k] and not density[k] and not t.named[max(0, parent[k])]
        kept[k] = below[k] and not gone[k] and not whole and (marked[k] or k > 0 and kept[parent[k]])
    return kept


def main_text(page: str | None) -> str:
    """The text of a page's content, a line for each block; empty if there is none."""
    if not page:
        return ""
    t = _parse(page)
    own = [0] * len(t.tag)
    for node, _, s in t.texts:
        own[node] += len(" ".join(s.split()))
    density, chars = node_densities(t.parent, t.tag, t.gone, t.named, own)
    if not chars[0]:
        return ""
    kept = selected(t, density, chars)
    blocks: dict[int, list[str]] = {}
    for node, block, s in t.texts:
        if kept[node]:
            blocks.setdefault(block, []).append(s)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; a narrow operation.

    A null or empty page, or one without content, has an empty text. Ids and urls are
    carried as they are (nulls and repeated rows too); other columns are not read, an empty table gives no rows.
    Time is in proportion to a page's length, however long it is and however deep its elements nest.
    Ties of density sums go to the outermost node.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_column).cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_text(spread(table(spark, sf_dir, "pages")))
