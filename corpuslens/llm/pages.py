"""Main text of web pages, by text-to-tag ratios.

The events of the standard library's HTML parser are turned into lines as they come: a line is the text of one block, with the tags
met since the line before and the containers it stands in. Each line has a ratio of text to tags; text of links and of containers that
are marked as something else than content (menus, adverts, forms, comments, by tag, role, class or id) counts as none. The
ratios are smoothed by a Gaussian over neighbouring lines and split by a threshold between two clusters, so that a short line
among long ones is content and a long one among links isn't. The clusters choose regions, not lines: the articles that hold content
lines, or else the innermost container that holds nearly all of them. A chosen region is given out whole but for what is marked and for
lists of links, so short paragraphs and headings stay.

White space (any that Unicode has) inside a block becomes one space, and blocks are joined by one. Null html counts as empty, and a
page without content has an empty text. Null ids and urls stay null; pages that repeat are extracted again; other columns are
ignored; an empty table gives no rows. Elements that are never closed end with what surrounds them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import bounded

EXTRACTED = "page_id long, url string, text string, n_chars long"
#: Standard deviation of the smoothing, in lines; a region must hold this share of the content lines' text to be entered, and an
#: article this share of the largest one's.
SIGMA, ENTERED, BESIDE = 1.5, 0.75, 0.25
#: As many linked lines in a row are a menu.
MENU_LINES = 3

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "map", "area", "input", "meta", "link",
}
BLOCKS_OF_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"}
TITLED = {"article", "post", "entry", "story", "content"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text nobody reads on the page, and those that are never content.
UNSEEN = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "noframes", "select", "textarea", "button", "datalist", "option", "optgroup"}
ASIDE = {"nav", "footer", "aside", "menu", "dialog", "header", "form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "status", "tablist"}
ARTICLES = {"article", "main"}
#: Words of class and id names.
REMARKS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion", "reviews", "guestbook"}
MARKS = REMARKS | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "sponsor", "sponsored", "sponsors", "promo", "promos", "promoted", "banner", "banners",
    "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "footer", "header", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "ccpa", "notice", "notices", "notification", "notifications", "alert", "popup", "modal", "overlay", "lightbox", "interstitial", "paywall", "toast",
    "subscribe", "subscription", "newsletter", "signup", "login", "signin", "search", "searchbox", "share", "sharing", "sharebar", "social", "socials", "related", "recommended", "recommendations", "trending",
    "pagination", "pager", "copyright", "skip", "skiplink", "tagcloud", "outbrain", "taboola", "form", "legal",
}
#: An opening tag of these ends the open ones named, up to the container around them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDERS = {"html", "body", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "table", "td", "th", "ul", "ol", "dl", "li", "dd", "blockquote", "fieldset", "details", "figure"}

COMMENT_END = re.compile(r"(?<!<!)--!?>|(?<=<!--)-?>")


def names(value: str | None) -> set[str]:
    """The words of class and id names, also of names like sideBar and ad-slot; not of those like with-sidebar."""
    words = [set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) for name in (value or "").split()]
    return set().union(*(w for w in words if not w & {"with", "has", "no", "without"}))


@dataclass
class Node:
    """A container. ``mark``: 0 for content, 1 if its name says otherwise, 2 if its tag does, 3 for readers' remarks, 4 for what isn't shown."""

    tag: str
    parent: int
    mark: int
    chars: int = 0


@dataclass
class Line:
    text: str
    node: int
    tag: str
    tags: int
    linked: int


class Lines(HTMLParser):
    """The lines and containers of a page, from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.lines = [Node("", -1, 0)], []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements, the container each is in or is, and if its text is hidden
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.unseen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag = next((t for t, *_ in reversed(self.stack) if t not in INLINE), "")
            self.lines.append(Line(text, self.stack[-1][1], tag, self.tags, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ("br", "hr") or (tag not in INLINE and tag in VOID):
            self.parts.append("\n")
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
            if tag in ENDS:
                self._end(ENDS[tag], HOLDERS - ENDS[tag])
            elif tag in HOLDERS or tag in BLOCKS_OF_TEXT or tag == "hr":
                self._end({"p"}, HOLDERS)
            if tag in HEADINGS:
                self._end(HEADINGS, HOLDERS)
            if tag == "body":
                self._end({"head"}, set())
        node, hides = self.stack[-1][1], tag in UNSEEN
        if tag in HOLDERS or tag in ASIDE or attrs or hides:
            mark = self._mark(tag, dict(attrs))
            hides |= mark == 4
            if tag not in INLINE and (tag in HOLDERS or mark):
                self.nodes.append(Node(tag, node, mark))
                node = len(self.nodes) - 1
        self.stack.append((tag, node, hides))
        self.open[tag] += 1
        self.unseen += hides

    def _mark(self, tag: str, attrs: dict[str, str | None]) -> int:
        style = re.sub(r"\s", "", attrs.get("style") or "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            return 4
        if tag in ("html", "body"):
            return 0
        own = names(attrs.get("class")) | names(attrs.get("id"))
        if own & REMARKS:
            return 3
        titled = tag in HEADINGS or any(self.open[t] for t in ARTICLES) or own & TITLED  # the head of an article has its title
        if tag in UNSEEN or tag in ASIDE or (attrs.get("role") or "").lower() in ROLES:
            return 0 if tag == "header" and titled else 2
        return int(bool(own & MARKS - ({"header"} if titled else set())) and tag not in ARTICLES)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        self._end({tag}, set() if tag in HOLDERS or tag in ASIDE else HOLDERS - {tag})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: a slash before the end of a tag means nothing

    def parse_html_declaration(self, i: int) -> int:
        """As browsers do: what isn't a comment ends with its first ``>``."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.parse_bogus_comment(i, 0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """As browsers do: a comment without an end lasts to the end of the page."""
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def _end(self, tags: set[str], walls: set[str]) -> None:
        """Closes the innermost open element among ``tags`` and all in it, if no wall stands before it."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                for t, _, hides in self.stack[k:]:
                    self.open[t] -= 1
                    self.unseen -= hides
                del self.stack[k:]
                return
            if self.stack[k][0] in walls:
                return

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over neighbours; at the ends over those that are there."""
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
    whole = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / whole


def threshold(values: np.ndarray) -> float:
    """Half way between the means of two clusters of the values' logarithms; values are 0 or more."""
    logs = np.log1p(values)
    low, high = float(logs.min()), float(logs.max())
    for _ in range(50):
        middle = (low + high) / 2
        above = logs > middle
        if not above.any() or above.all():
            break
        new = float(logs[~above].mean()), float(logs[above].mean())
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def content(page: Lines) -> list[Line]:
    """The lines of the regions that the clusters choose."""
    nodes, lines = page.nodes, page.lines
    _unmark(nodes, lines)
    marked = np.zeros(len(nodes), bool)
    for k, node in enumerate(nodes):  # a container comes after the one around it
        marked[k] = bool(node.mark) or (k > 0 and marked[node.parent])
    own = np.array([0 if marked[x.node] else max(0, len(x.text) - x.linked) for x in lines], float)
    if not own.any():
        return []
    ratios = smooth(own / np.array([max(1, x.tags) for x in lines], float))
    core = (ratios >= threshold(ratios)) & (own > 0)
    if not core.any():
        core = own > 0
    for node in nodes:
        node.chars = 0
    for k in np.flatnonzero(core):
        nodes[lines[k].node].chars += len(lines[k].text)
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
    inside = np.zeros(len(nodes), bool)
    for k in _regions(nodes, lines, core, marked):
        inside[k] = True
    for k in range(1, len(nodes)):
        inside[k] |= inside[nodes[k].parent]
    kept = [k for k, x in enumerate(lines) if inside[x.node] and not marked[x.node]]
    if inside[0]:  # no container: what comes before the first content line and after the last one isn't content, but for a heading
        at = np.flatnonzero(core)
        first = int(at[0])
        while first and lines[first - 1].tag in HEADINGS:
            first -= 1
        kept = [k for k in kept if first <= k <= at[-1]]
    elif kept and not any(lines[k].tag in ("h1", "h2") for k in kept):
        first = kept[0]
        while first and lines[first - 1].tag in HEADINGS and not marked[lines[first - 1].node]:
            first -= 1
        kept = [*range(first, kept[0]), *kept]
    return _without_menus([lines[k] for k in kept])


def _unmark(nodes: list[Node], lines: list[Line]) -> None:
    """A container that is marked, but holds the page's article, is a wrapper (a form around a whole page, a class like with-sidebar)."""
    chars = [0] * len(nodes)
    for line in lines:
        if line.tag in BLOCKS_OF_TEXT or line.tag in ARTICLES:
            chars[line.node] += len(line.text) - line.linked
    free = list(chars)
    for k in range(len(nodes) - 1, 0, -1):  # without the text of containers that are marked further in
        if not nodes[k].mark:
            free[nodes[k].parent] += free[k]
        chars[nodes[k].parent] += chars[k]
    open_ = [k == 0 or not n.mark for k, n in enumerate(nodes)]
    for k in range(1, len(nodes)):
        open_[k] &= open_[nodes[k].parent]
    if any(n.tag in ARTICLES and open_[k] and free[k] for k, n in enumerate(nodes)):
        return
    inner = [k for k, n in enumerate(nodes) if n.tag in ARTICLES and n.mark < 3 and free[k]]
    best = max(inner, key=lambda k: free[k], default=None)
    if best is None:
        seen = sum(free[k] for k, n in enumerate(nodes) if n.mark and n.mark < 3) + free[0]
        wide = [k for k, n in enumerate(nodes) if (n.mark == 1 or n.tag == "form") and n.mark < 3 and free[k] > 2 * free[0] and 2 * free[k] > seen]
        best = max(wide, key=lambda k: free[k], default=None)
    around = []
    while best is not None and best > 0:
        around.append(best)
        best = nodes[best].parent
    if not any(nodes[k].mark >= 3 for k in around):
        for k in around:
            nodes[k].mark = 0


def _regions(nodes: list[Node], lines: list[Line], core: np.ndarray, marked: np.ndarray) -> list[int]:
    """The containers to give out: articles with content lines, or the innermost container with nearly all of them."""
    for tag in ("article", "main"):
        found = [k for k, n in enumerate(nodes) if n.tag == tag and not marked[k] and n.chars]
        if found:
            most = max(nodes[k].chars for k in found)
            return [k for k in found if nodes[k].chars >= BESIDE * most]
    inner: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        inner.setdefault(nodes[k].parent, []).append(k)
    texts = {x.node for k, x in enumerate(lines) if core[k] and x.tag in BLOCKS_OF_TEXT}
    at = 0
    while True:
        below = max(inner.get(at, []), key=lambda k: nodes[k].chars, default=None)
        if below is None or nodes[below].chars < ENTERED * nodes[at].chars or nodes[below].tag in ("li", "td", "blockquote", "ul", "ol"):
            return [at]
        if at in texts and nodes[at].tag not in ("", "html", "body"):  # paragraphs of its own beside the one below
            return [at]
        at = below


def _without_menus(lines: list[Line]) -> list[Line]:
    """Without runs of lines that are links and nothing else."""
    links = [x.linked >= 0.9 * len(x.text) and x.tag not in ("p", *HEADINGS) for x in lines]
    out, k = [], 0
    while k < len(lines):
        n = k
        while n < len(lines) and links[n]:
            n += 1
        if n - k < MENU_LINES:
            out += lines[k : max(n, k + 1)]
        k = max(n, k + 1)
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page, html = Lines(), html or ""
    end = html.rfind(">") + 1  # no tag ends after it; the parser would look for its end from each "<" on
    page.feed(html[:end] + re.split(r"<[a-zA-Z/!?]", html[end:], maxsplit=1)[0])
    page.close()
    return " ".join(x.text for x in content(page)) if page.lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in arrays.text_slices(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bounded(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)
