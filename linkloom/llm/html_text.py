"""Main text of web pages by composite text density.

A page becomes a tree of elements; scripts, styles, forms, menus, page headers and
footers, sidebars, notices, adverts and reader comments are left out by element,
role or class. Every node has its characters C and elements T, and those in links,
LC and LT, and the density

    C / T  x  log_b(C / LC x T / LT),   b = ln(C / (C - LC) x LC + LC_body / C_body x C + e)

with empty counts taken as one. The node with the largest sum of its children's
densities holds the article; the least density between it and the body is the
threshold. If it lies in an article or main element, that element is the
article. Otherwise every node that reaches the threshold contributes the node of the
largest sum in its subtree.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined in page order by one space. Pages are independent rows, each
read in one pass with flat arrays, so depth and length are not limited.

Defined results: null, empty and textless pages give empty text; unclosed
elements end where their parents do; repeated rows and extra columns make no
difference.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is not markup.
RAW = frozenset("script style textarea title noscript template iframe object svg math xmp noframes".split())
LEFT_OUT = frozenset("nav footer aside form button select label dialog menu figure audio video canvas".split()) | RAW | {"head"}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id names that mark what is not the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup sidebar aside "
    "widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies "
    "respond disqus share sharing social related recommended recommendations toolbar pagination pager login "
    "search copyright disclaimer".split()
)
# An open element of the second kind ends where one of the first kind begins.
_ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_HOLDERS = frozenset("ul ol dl table body div article main section blockquote".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for single in value.split():
                words = [w.lower() for w in _PARTS.findall(single)]
                if tag in ARTICLE and len(words) > 1:
                    continue
                if words and words[0] not in ("has", "no", "with", "without"):
                    if not WORDS.isdisjoint(words) or ("header" in words and not in_article):
                        return True
    return False


class _Tree:
    """Elements in page order, as flat lists, and the pieces of text between them."""

    def __init__(self, page: str):
        self.tag, self.parent, self.out = ["body"], [0], [False]
        self.chars, self.linked, self.in_link, self.in_article = [0], [0], [False], [False]
        # Pieces are (node, text); a node of -1 ends a block.
        self.pieces: list[tuple[int, str]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, at, size = [0], 0, len(page)
        while at < size:
            found = _TOKEN.search(page, at)
            begin = found.start() if found else size
            if begin > at:
                self._text(stack[-1], page[at:begin])
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                if found[0].startswith("<![CDATA["):
                    self._text(stack[-1], found[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if name not in INLINE:
                self.pieces.append((-1, ""))
            if found[1] or found[4]:
                self._close(stack, name)
                continue
            attributes = found[3] or found[6] or ""
            if name in ("html", "body"):
                continue
            self._open(stack, name, attributes)
            if name in VOID or attributes.endswith("/") and name in ("svg", "math"):
                stack.pop()
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name not in INLINE and name not in VOID:
            # A paragraph cannot hold a block.
            self._end(stack, ("p",), _HOLDERS)
            if name in _ENDS:
                self._end(stack, _ENDS[name], frozenset(("ul", "ol", "dl", "table", "select")))
        top = stack[-1]
        inside = self.in_article[top]
        self.tag.append(name)
        self.parent.append(top)
        self.out.append(self.out[top] or _unwanted(name, attributes, inside))
        self.in_link.append(self.in_link[top] or name == "a")
        self.in_article.append(inside or name in ARTICLE)
        self.chars.append(0)
        self.linked.append(0)
        stack.append(len(self.tag) - 1)

    def _end(self, stack: list[int], names: tuple[str, ...], within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in within:
                return

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                del stack[k:]
                return
            # An inline end tag does not end blocks.
            if name in INLINE and tag not in INLINE:
                return

    def _text(self, node: int, text: str) -> None:
        if self.out[node]:
            return
        if "&" in text:
            text = references.unescape(text)
        self.pieces.append((node, text))
        n = len("".join(text.split()))
        self.chars[node] += n
        if self.in_link[node]:
            self.linked[node] += n

    def text(self) -> str:
        marked = self._marked()
        parts = [" " if node < 0 else text for node, text in self.pieces if node < 0 or marked[node]]
        return " ".join("".join(parts).split())

    def _marked(self) -> list[bool]:
        count = len(self.tag)
        chars, linked = self.chars[:], self.linked[:]
        tags, link_tags = [0] * count, [0] * count
        for k in range(count - 1, 0, -1):
            up = self.parent[k]
            if not self.out[k]:
                chars[up] += chars[k]
                linked[up] += linked[k]
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k] + (self.tag[k] == "a")
        if not chars[0]:
            return [False] * count
        share = linked[0] / chars[0]
        density = [
            0.0 if self.out[k] or not chars[k] else _density(chars[k], linked[k], tags[k], link_tags[k], share)
            for k in range(count)
        ]
        sums, leaf = [0.0] * count, [True] * count
        for k in range(1, count):
            if not self.out[k]:
                sums[self.parent[k]] += density[k]
                leaf[self.parent[k]] = False
        sums = [density[k] if leaf[k] else sums[k] for k in range(count)]
        best = max(range(count), key=lambda k: (sums[k], -k))
        threshold, node, article = density[best], best, -1
        while True:
            threshold = min(threshold, density[node])
            if self.tag[node] in ARTICLE:
                article = node
            if node == 0:
                break
            node = self.parent[node]
        marked = [False] * count
        if article >= 0 or sums[best] <= 0:
            marked[max(article, 0)] = True
        else:
            top = list(range(count))  # the node of the largest sum in the subtree
            for k in range(count - 1, 0, -1):
                up = self.parent[k]
                if not self.out[k] and sums[top[k]] > sums[top[up]]:
                    top[up] = top[k]
            for k in range(count):
                if density[k] > 0 and density[k] >= threshold:
                    marked[top[k]] = True
        for k in range(1, count):
            marked[k] = (marked[k] or marked[self.parent[k]]) and not self.out[k]
        return marked


def _density(chars: int, linked: int, tags: int, link_tags: int, share: float) -> float:
    plain = max(1, chars - linked)
    # Never below e, so b is 1 or more; its logarithm is kept off zero.
    base = math.log(chars / plain * linked + share * chars + math.e)
    ratio = chars / max(1, linked) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(ratio) / max(math.log(base), 1e-2) if ratio > 1 else 0.0


def main_text_of(page: str | None) -> str:
    return _Tree(page).text() if page else ""


def main_text(page: Column) -> Column:
    """The article's text of each page, in Arrow batches."""

    @F.pandas_udf("string")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text_of(p) for p in part], dtype="str")

    return F.coalesce(work(page), F.lit(""))
