"""Main text of web pages.

The standard library's parser reads a page once, from front to back, and its events make lines: runs of text between the
tags that break a line. Each line has a ratio of its characters outside links to the tags around it. The ratios are
smoothed over neighbouring lines by a Gaussian; lines of at least one standard deviation are content (threshold clustering).
The element that holds most of the content's characters is the page's region, and all its lines but marked ones
are the text, short ones included.

Marked lines stand in elements that by name, role, class or id are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments. An article's own header keeps its headings. An element around
an article or main element is not marked, nor a form around a first heading (either may wrap the whole page).

Defined cases: a null or empty page, and one with marked lines only, has an empty text; what no tag closes ends with what
it stands in; tags, declarations and comments without an end take the rest; pages are independent, so repeats, ties and null ids need
no rule; a page is held in one task, whole, however long; an empty table gives an empty result; columns other than page_id, url
and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Standard deviation of the Gaussian, in lines, and lines to each side that it reaches.
SIGMA, REACH = 1.0, 2
#: Share of the content's characters from which on an article or main element is the region.
SHARE = 1 / 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label link mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open element of the same kind, up to the list or table around it.
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl menu table select".split())
MARKED = frozenset("nav footer aside form script style noscript template iframe object svg canvas audio video select button textarea dialog menu head title".split())
ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar banner".split())
#: Words of classes and ids that mark an element.
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar sidebar aside widget ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored"
    " promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing"
    " related recommended comment comments commentlist disqus respond reply replies discussion pagination pager toolbar copyright".split()
)
#: Before `header` they say that it is the article's own.
OWN = frozenset("article content entry post story".split())
#: Before a word they say that the element only goes with one.
WITH = frozenset("has no not with without is can".split())
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def names_of(attrs: list[tuple[str, str | None]]) -> Iterator[list[str]]:
    """The words of each class and of the id, in lower case."""
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.split():
                yield [w.lower() for w in PART.findall(name)]


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """`marked`, `header`, `title` (an article's own header) or nothing."""
    names = [n for n in names_of(attrs) if n and n[0] not in WITH]
    if tag in ("html", "body", "main"):
        return ""
    if tag == "article":
        return "marked" if any(w in ("comment", "reply") for n in names for w in n) else ""
    role = next((v.lower() for k, v in attrs if k == "role" and v), "")
    if tag in MARKED or role in ROLES or any(w in WORDS for n in names for w in n):
        return "marked"
    if any("header" in n and n[0] in OWN for n in names):
        return "title"
    return "header" if tag == "header" or any("header" in n for n in names) else ""


class Page(HTMLParser):
    """Elements and lines of a page, from the parser's events."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # of each element: parent, name, mark, whether it is an article or main one
        self.parent, self.tag, self.mark, self.article = [-1], [""], [""], [False]
        self.open, self.names = [0], Counter[str]()
        # of each line: text, characters in links, tags, element, whether it is a heading
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.text: list[str] = []
        self.linked = self.tags = self.hidden = 0
        self.link = False
        self.feed(html)
        self.close()
        self.line()

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at = self.open[-1]
            self.lines.append((text, min(self.linked, len(text)), self.tags, at, self.tag[at] in HEADINGS))
            self.tags = 0
        self.text, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.names[self.tag[at]] -= 1
            self.hidden -= self.tag[at] in INLINE
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.link = True
        if tag in INLINE:
            if tag not in VOID and mark_of(tag, attrs) == "marked":
                self.push(tag, attrs)
                self.hidden += 1
            return
        self.line()
        self.link = False
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name in ITEMS.get(tag, ()) or name == "p":
                self.close_to(depth)
                break
            if name not in INLINE and (name not in HEADINGS | {"dt", "dd", "li", "td", "th"} or tag not in ITEMS) or name in LISTS:
                break
        if tag not in VOID:
            self.push(tag, attrs)

    def push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = next((v.lower() for k, v in attrs if k in ("role", "itemprop") and v), "")
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.mark.append(mark_of(tag, attrs))
        self.article.append((tag in ("article", "main") or kind in ("article", "main", "articlebody")) and self.mark[-1] != "marked")
        self.open.append(len(self.tag) - 1)
        self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = False
        if tag not in INLINE:
            self.line()
        if self.names[tag]:
            depth = next(d for d in range(len(self.open) - 1, 0, -1) if self.tag[self.open[d]] == tag)
            if tag not in INLINE or all(self.tag[at] in INLINE for at in self.open[depth:]):
                self.close_to(depth)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.link:
                self.linked += len(data)

    # The whole page has been fed, so what has no end here has none: it ends at the next `>` or takes the rest.

    def after(self, end: int, i: int) -> int:
        end = end if end >= 0 else self.rawdata.find(">", i) + 1
        return end or len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self.after(super().parse_starttag(i), i)

    def parse_endtag(self, i: int) -> int:
        return self.after(super().parse_endtag(i), i)

    def parse_pi(self, i: int) -> int:
        return self.after(-1, i)

    def parse_html_declaration(self, i: int) -> int:
        return self.after(-1, i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Weighted means by a Gaussian; at the ends, of the lines that are there."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(ratios, kernel)[REACH:-REACH] / np.convolve(np.ones(len(ratios)), kernel)[REACH:-REACH]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    n = len(page.tag)
    around = [False] * n  # there is an article inside
    first = [False] * n  # there is a first heading inside
    for at in range(n - 1, 0, -1):
        around[page.parent[at]] |= page.article[at] or around[at]
        first[page.parent[at]] |= page.tag[at] == "h1" or first[at]
    marked, header, inside = [False] * n, [False] * n, [False] * n
    for at in range(1, n):
        up = page.parent[at]
        inside[at] = inside[up] or page.article[at]
        mark = "" if around[at] or (page.tag[at] == "form" and first[at]) else page.mark[at]
        marked[at] = marked[up] or mark == "marked" or (mark == "header" and not inside[at])
        header[at] = header[up] or mark in ("header", "title")
    lines = page.lines
    free = [not marked[at] and (heading or not header[at]) for _, _, _, at, heading in lines]
    if not any(free):
        return ""
    smoothed = smooth(np.array([(len(text) - linked) / max(1, tags) for text, linked, tags, _, _ in lines]))
    content = [f and s for f, s in zip(free, (smoothed >= smoothed.std()).tolist())]
    if not any(content):
        content = free
    held, chars, links = [0] * n, [0] * n, [0] * n
    for (text, linked, _, at, _), f, c in zip(lines, free, content):
        held[at] += c * len(text)
        chars[at] += f * len(text)
        links[at] += f * linked
    for at in range(n - 1, 0, -1):
        for sums in (held, chars, links):
            sums[page.parent[at]] += sums[at]
    region = _region(page, held, chars, links, marked)
    under = [at == region for at in range(n)]
    for at in range(1, n):
        under[at] = under[at] or under[page.parent[at]]
    chosen = [i for i, line in enumerate(lines) if free[i] and under[line[3]]]
    if page.tag[region] in ("", "html", "body"):  # no element around the article: from its first line of content to its last
        ends = [i for i in chosen if content[i]]
        chosen = [i for i in chosen if ends[0] <= i <= ends[-1]]
    if not page.article[region]:
        before = [i for i in range(chosen[0]) if free[i]]
        while before and lines[before[-1]][4]:
            chosen.insert(0, before.pop())
    return " ".join(lines[i][0] for i in chosen)


def _region(page: Page, held: list[int], chars: list[int], links: list[int], marked: list[bool]) -> int:
    """The innermost article that holds most of the content, or else the innermost element that does and, up to the body, those around it that add more than links."""
    articles = [at for at in range(1, len(held)) if page.article[at] and not marked[at] and held[at] >= SHARE * held[0] and held[at]]
    if articles:
        most = max(held[at] for at in articles)
        return [at for at in articles if 2 * held[at] > most][-1]
    at = [at for at in range(len(held)) if 2 * held[at] > held[0]][-1]
    while at and page.tag[page.parent[at]] not in ("", "html", "body"):
        up = page.parent[at]
        if 2 * (links[up] - links[at]) > chars[up] - chars[at]:
            break
        at = up
    return at


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 100):
        texts = list(map(main_text, part["html"].to_pylist()))
        yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = pages.select("page_id", "url", "html").mapInArrow(_extracted, pages.select("page_id", "url", F.col("html").alias("text")).schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))
