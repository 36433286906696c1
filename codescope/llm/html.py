"""Main text of web pages by composite text density (operator 10).

Every node of a page's tree gets a density: characters per tag, lowered by the share of link
text. The node whose children's densities sum highest holds the article; the least density on
its path to the body is the threshold for parts beside it.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
# Tags that never hold article text.
DROPPED = {
    "head", "script", "style", "title", "textarea", "noscript", "iframe", "template", "nav", "footer", "aside", "form", "button",
    "select", "option", "input", "dialog", "svg", "canvas", "object", "embed", "menu", "search", "audio", "video", "map",
}
# Words of class, id and role that mark parts around an article.
HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav",
    "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "topbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments",
    "disqus", "respond", "pagination", "pager", "toolbar", "widget", "complementary", "contentinfo", "copyright", "legal", "skip",
}
COMMENT_HINTS = {"disqus", "respond"}
# Words that also mark an article's own parts.
IN_ARTICLE = {"header", "masthead", "banner"}
KEPT = {"html", "body", "main", "article"}
# What a start tag closes by being there, up to the tags that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
IN_PARAGRAPH = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}


NOT, BY_TAG, BY_HINT = 0, 1, 2  # why a node is dropped
ARTICLES = {"article", "main"}


class Page:
    """The tree of a page: per node its parent, tag and whether it is dropped; texts in order with
    their node and block. A node's number is higher than its parent's. The work is linear in the
    page, however deep it nests."""

    def __init__(self, source: str):
        self.parent, self.tag, self.reason, self.inside = [-1], ["html"], [NOT], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.opened: dict[str, int] = {}  # open elements by tag
        self._parse(source)
        self._spare_wrappers()
        self.dropped = [False]
        for p, reason in zip(self.parent[1:], self.reason[1:]):
            self.dropped.append(self.dropped[p] or reason != NOT)

    def _spare_wrappers(self) -> None:
        """A hint word does not drop what holds the article: all article and main elements of the
        page, or, where there are none, most of its text. The densities choose there."""
        n = len(self.tag)
        gone = [False] * n
        size, articles = [0] * n, [0] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or self.reason[i] == BY_TAG
            articles[i] = int(self.tag[i] in ARTICLES and not gone[i])
        for node, _, text in self.texts:
            if not gone[node]:
                size[node] += len(text.strip())
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            articles[self.parent[i]] += articles[i]
        for i in range(1, n):
            if self.reason[i] == BY_HINT:
                holds_all = articles[i] == articles[0] if articles[0] else 2 * size[i] > size[0]
                if holds_all:
                    self.reason[i] = NOT

    def _open(self, name: str, rest: str, stack: list[int]) -> None:
        if name in IN_PARAGRAPH:
            self._close_until({"p"}, {"table", "td", "th", "article", "section", "div", "li"} - {name}, stack)
        if name in CLOSES:
            self._close_until(*CLOSES[name], stack)
        if name in BLOCKS:
            self.block += 1
        top = stack[-1]
        self.parent.append(top)
        self.tag.append(name)
        self.reason.append(self._unwanted(name, rest, self.inside[top]))
        self.inside.append(self.inside[top] or name in ARTICLES)
        if name not in VOID and not (rest.endswith("/") and name not in BLOCKS):
            stack.append(len(self.tag) - 1)
            self.opened[name] = self.opened.get(name, 0) + 1
        elif name == "br":
            self.texts.append((top, self.block, " "))

    def _unwanted(self, name: str, rest: str, inside: bool) -> int:
        if name in DROPPED or (name == "header" and not inside):
            return BY_TAG
        hints = {w for m in HINT.finditer(rest) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())} if rest else set()
        if any(h.startswith("comment") for h in hints) or hints & COMMENT_HINTS:
            return BY_TAG
        if name in KEPT:
            return NOT
        return BY_HINT if hints & (HINTS - IN_ARTICLE if inside else HINTS) else NOT

    def _close(self, i: int, stack: list[int]) -> None:
        for node in stack[i:]:
            self.opened[self.tag[node]] -= 1
        del stack[i:]

    def _close_until(self, names: set[str], stops: set[str], stack: list[int]) -> None:
        if not any(self.opened.get(x) for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                self._close(i, stack)
                self.block += 1
                return
            if tag in stops:
                return

    def _end(self, name: str, stack: list[int]) -> None:
        if name in BLOCKS:
            self.block += 1
        if not self.opened.get(name):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                self._close(i, stack)
                return
            if name not in BLOCKS and tag in BLOCKS:
                return

    def _parse(self, source: str) -> None:
        stack, at, ends = [0], 0, {}
        while at < len(source):
            found = TAG.search(source, at)
            if found is None or found.start() > at:
                piece = source[at : found.start() if found else len(source)]
                self.texts.append((stack[-1], self.block, unescape(piece) if "&" in piece else piece))
            if found is None:
                break
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            if found["close"] or found["close2"]:
                self._end(name, stack)
                continue
            if name == "html":
                continue
            self._open(name, found["rest"] or found["rest2"] or "", stack)
            if name in RAW:
                close = ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)).search(source, at)
                at = close.end() if close else len(source)
                self._end(name, stack)


def densities(page: Page, body: int) -> tuple[list[float], list[float]]:
    """(density, sum of the children's densities) of every node.

    With c characters and t tags in a subtree, lc and lt of them in links, the density is c / t
    times the logarithm of (c / lc) * (t / lt), to a base that grows with the share of links in
    the node and in the body.
    """
    n = len(page.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
        link_tags[i] = int(page.tag[i] == "a")
    for node, _, text in page.texts:
        if not page.dropped[node]:
            size = len("".join(text.split()))
            chars[node] += size
            links[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
    share = links[body] / max(1, chars[body])
    own, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, lc = chars[i], links[i]
        if not c or page.dropped[i]:
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = c / max(1, lc) * tags[i] / max(1, link_tags[i])
        own[i] = max(0.0, c / tags[i] * math.log(max(ratio, 1.0)) / (math.log(base) if base > 1 + 1e-9 else 1.0))
        if i:
            total[page.parent[i]] += own[i]
    return own, total


def _chosen(page: Page) -> list[bool]:
    """Which nodes belong to the article: the subtree with the highest sum, the rest of the
    article or main element around it if there is one, else parts beside its path to the body
    that reach the threshold, and headings there."""
    n = len(page.tag)
    body = page.tag.index("body") if "body" in page.tag else 0
    own, total = densities(page, body)
    open_nodes = [i for i in range(n) if not page.dropped[i]]
    best = max(open_nodes, key=lambda i: (total[i], own[i], -i), default=0)
    path = [best]
    while path[-1] not in (body, 0):
        path.append(page.parent[path[-1]])
    within = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] == "main"]
    chosen = [False] * n
    chosen[within[-1] if within else best] = True
    threshold = min(own[i] for i in path)
    if not within:
        on_path = set(path)
        for i in open_nodes:
            if i and page.parent[i] in on_path and i not in on_path and (own[i] >= threshold > 0 or page.tag[i] in ("h1", "h2", "h3")):
                chosen[i] = True
    for i in range(1, n):
        chosen[i] = (chosen[i] or chosen[page.parent[i]]) and not page.dropped[i]
    return chosen


def main_text(source: str | None) -> str:
    """The article's blocks, white space in each made single spaces, joined by empty lines."""
    if not source:
        return ""
    page = Page(source)
    chosen = _chosen(page)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if chosen[node]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text under ``name`` (in place of a column of that name).

    Null and empty pages, and pages without text, give an empty text. Whole pages are read;
    other columns are passed on as they are.
    """
    return pages.withColumn(name, _extracted(F.col(f"`{html}`")))


def _extracted(html: Column) -> Column:
    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        return sources.map(main_text)

    return texts(F.coalesce(html, F.lit("")))
