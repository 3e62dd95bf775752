"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into one line per block element. A line's weight is the length of its text; it
is zero inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
(told by element, role, class or id), and outside the article element where the page has one. A class
or id counts by its last telling part, as the noun of a compound: `comment-body` and `left-sidebar` are
noise, `nav-history` and `legal-article` are not. Inside an article, headings, notices of law and forms
of words stay text, and so do lists of links; an article element that is named as a comment or an advert
is noise itself.
Weights are summed over a sliding window of lines. A region begins where the sum surges from zero
and ends where it dives to zero; text between is kept, without the lines of weight zero. A page
with an article keeps all its regions, as all weight lies within it; another page keeps every region
that surges to SURGE and the short ones that continue the element such a region lies in, or all regions
if none surges, and text of link lists has no weight.

A null page is empty and gives the empty text, as does a page without text. Repeated rows give equal
results. Pages of any length are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 80

# HTML element names by kind.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "audio", "video", "canvas", "select", "button", "noframes", "noembed", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
          "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
          "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
          "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
          "tfoot", "thead", "tr", "ul"}
SCOPES = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav",
          "ol", "section", "table", "td", "th", "ul", "dialog", "details", "figure", "blockquote"}
HOLDERS = {"body", "div", "section", "td"}
NOISY = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
         "alertdialog", "form", "menu", "menubar", "toolbar", "status", "note"}
# Words in class and id names of what is not the article.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot",
    "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "topbar", "footer",
    "copyright", "legal", "sidebar", "aside", "widget", "related", "recommended", "recommendations",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup",
    "modal", "overlay", "paywall", "newsletter", "subscribe", "subscription", "signup", "login",
    "form", "search", "share", "sharing", "social", "comment", "comments", "commentlist", "reply",
    "replies", "respond", "disqus", "skip", "toolbar", "hidden",
}

# Those of them that can be part of an article's own text or title.
ARTICLE_WORDS = {"header", "masthead", "legal", "form", "alert", "banner", "hidden", "search", "copyright", "aside", "skip"}
CLEAR_NOISE = NOISE_WORDS - ARTICLE_WORDS
# Parts of names that say how an element looks or where it is, not what it holds.
PLAIN_PARTS = {
    "area", "author", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content",
    "desktop", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "mobile", "outer",
    "panel", "right", "row", "section", "slot", "stories", "text", "thread", "top", "unit", "wrap", "wrapper",
}
# Parts that make a name speak of something beside the element.
RELATING = {"with", "without", "has", "no", "of", "is", "not"}
CLEAR_ROLES = {"navigation", "search", "form", "menu", "menubar", "toolbar"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    quiet: bool = False
    inside: bool = False
    item: bool = False
    parent: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names_noise(name: str, words: set[str]) -> bool:
    """Whether a class or id names noise: by its last part that is not plain, or as a whole."""
    parts = [part.lower() for part in _NAME_PART.findall(name)]
    if "".join(parts) in words:
        return True
    if RELATING.intersection(parts):
        return False
    telling = [part for part in parts if part not in PLAIN_PARTS and not part.isdigit()]
    return bool(telling) and telling[-1] in words


def _noisy(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is not text of the page; inside an article only what is clearly not."""
    if tag in NOISY or tag == "header" and not inside:
        return True
    words, roles = (CLEAR_NOISE, CLEAR_ROLES) if inside else (NOISE_WORDS, ROLES)
    if not attrs:
        return False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "role" and value.strip().lower() in roles:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            if any(_names_noise(v, words) for v in value.split()):
                return True
    return re.search(r"(?:^|\s)hidden(?=\s|=|$)", attrs) is not None


def split_lines(page: str) -> tuple[list[Line], bool]:
    """Lines of a page in order, and whether it has an article element."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []  # element; quiet, inside, link, item, parent
    open_ = Counter()
    fresh, has_article, at, line, scopes = True, False, 0, Line(), 0

    def close(k: int) -> None:
        open_.subtract(e[0] for e in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal fresh, line
        if not text:
            return
        _, quiet, inside, link, item, parent = stack[-1] if stack else ("", False, False, False, False, 0)
        text = html.unescape(text)
        if fresh or quiet != line.quiet or inside != line.inside:
            if not text.strip():
                if not fresh:
                    line.parts.append(" ")
                return
            line = Line(quiet=quiet, inside=inside, item=item, parent=parent)
            lines.append(line)
            fresh = False
        line.parts.append(text)
        if link:
            line.linked += len("".join(text.split()))

    for token in _TOKEN.finditer(page):
        add(page[at:token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in ("br", "td", "th", "dd", "dt") and not fresh:
            line.parts.append(" ")
        if tag in BLOCKS:
            fresh = True
        if token["end"]:
            for k in range(len(stack) - 1, -1, -1) if open_[tag] > 0 else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPES and tag not in SCOPES:
                    break
            continue
        if tag in VOID or token["attrs"].endswith("/") and tag not in SCOPES:
            continue
        if tag in BLOCKS and (open_["p"] > 0 or tag == "li" and open_[tag] > 0):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag == "li":
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        _, quiet, inside, link, item, parent = stack[-1] if stack else ("", False, False, False, False, 0)
        main = tag in ("article", "main")
        quiet = quiet or _noisy(tag, token["attrs"], inside or main)
        if main and not quiet:
            inside = has_article = True
        if tag in HOLDERS:
            scopes += 1
            parent = scopes
        open_[tag] += 1
        stack.append((tag, quiet, inside, link or tag == "a", item or tag == "li", parent))
    add(page[at:])
    return lines, has_article


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between the surges and dives of the text distribution, joined by line feeds."""
    lines, has_article = split_lines(page or "")
    texts = [line.text() for line in lines]
    weight = np.zeros(len(lines) + window, np.int64)
    for k, (line, text) in enumerate(zip(lines, texts)):
        links = line.linked * 2 > len(text) and not has_article
        if not (line.quiet or links or has_article and not line.inside):
            weight[k] = len(text)
    total = np.convolve(weight, np.ones(window, np.int64))[window - 1:]
    filled = np.concatenate(([0], (total[:len(lines)] > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(filled))
    regions = list(zip(edge[::2], edge[1::2] + window - 1))
    if not has_article and regions:
        peak = [total[a:b - window + 1].max() for a, b in regions]
        full = [r for r, p in zip(regions, peak) if p >= surge]

        def parents(a: int, b: int) -> set[int]:
            return {line.parent for line, w in zip(lines[a:b], weight[a:b]) if w}

        held = set().union(*(parents(a, b) for a, b in full))
        regions = [r for r in regions if r in full or held & parents(*r)] if full else regions
    kept = np.zeros(len(weight), bool)
    for a, b in regions:
        kept[a:b] = True
    return "\n".join(t for k, t in enumerate(texts) if kept[k] and weight[k] and t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long")
