"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. A line is what stands between two borders of blocks, as if every
block began on a line of its own; its ratio is the number of its unlinked characters by that of its tags. Ratios are
smoothed by a Gaussian over the lines, and lines whose smoothed ratio reaches one standard deviation are content. The
content region is the article (or main element) that holds most of these characters; without one, the deepest element
that does, from the first to the last content line and on over the paragraphs beside them. Every line of the region
stays, short ones too, but for what elements, roles and the words of class and id mark as no part of the article.

A page is read by one row's call, so pages need no shuffle, and lost tasks are simply run again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorespark.llm.shared import small_batches, spare, text_or_empty

#: Gaussian in lines, and the share of the content's characters that an element without meaning of its own must hold.
SIGMA, MOST = 1.0, 0.8
#: Characters given to the parser at once.
FEED = 1 << 18

_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption address summary".split())
_HOLDERS = frozenset("html body div section article main td center".split())
_BLOCKS = _PARAGRAPHS | _HOLDERS | frozenset("head title nav header footer aside form fieldset ul ol menu dl table thead tbody tfoot tr figure details dialog hgroup search noscript template".split())
#: Cells of a row share its line.
_BORDERS = _BLOCKS - {"td"}
#: Dropped without ending the block that they stand in.
_SILENT = frozenset("script style button select textarea svg math object iframe canvas audio video datalist label legend option".split())
_CUT = frozenset("head title nav footer aside dialog search menu noscript template".split()) | _SILENT
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element closes when it begins, and what keeps it from looking further out.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td"}, {"tr", "table"})} | {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class or id: whole ones, and beginnings of words.
_CUE_WORDS = frozenset("ad ads adv dfp nav menu menus header banner notice notices alert alerts toast popup modal overlay reply replies respond login signup search widget form toolbar topbar pager pagination share sharing social related recommended recommendations teaser teasers outbrain taboola legal copyright skip rail".split())
_CUE_STARTS = ("advert", "sponsor", "promo", "cookie", "consent", "gdpr", "sidebar", "sidenav", "navbar", "navig", "breadcrumb", "footer", "masthead", "newsletter", "subscri", "commentlist", "disqus", "paywall", "menuitem")
_COMMENTS = re.compile(r"comments?(er|ers|list|thread|section|box|form|area)?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _cued(attrs: dict[str, str | None]) -> bool:
    if "class" not in attrs and "id" not in attrs:
        return False
    words = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower()
    return any(w in _CUE_WORDS or w.startswith(_CUE_STARTS) or _COMMENTS.fullmatch(w) for w in re.findall(r"[a-z]+", words))


class _Page(HTMLParser):
    """Elements (parent, tag, cut, cued, chief: an article or main element) and lines (element, text, tags, linked characters) of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.cut, self.cued, self.chief = [-1], ["html"], [False], [False], [False]
        self.open: list[int] = [0]
        self.lines: list[tuple[int, str, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def updatepos(self, i, j):  # line numbers are not asked for
        return j

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or self.tags:
            self.lines.append((self.open[-1], text, self.tags, self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def shut(self, depth: int) -> None:
        """Close the open elements from this depth on."""
        if any(self.tag[i] in _BORDERS for i in self.open[depth:]):
            self.flush()
        del self.open[depth:]

    def close_until(self, closed: set[str], walls: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in walls:
                return
            if tag in closed:
                return self.shut(depth)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag == "a":
            self.links += 1
        self.tags += 1
        block = tag in _BLOCKS or tag == "th"
        if tag in _VOID or tag == "html" or not block and tag not in _SILENT:
            return
        tag = "td" if tag == "th" else tag
        if block:
            self.tags -= 1
            if tag in _BORDERS or not any(self.tag[i] == "tr" for i in self.open):
                self.flush()
            else:
                self.parts.append(" ")
            if tag not in ("title", "noscript", "template"):
                self.close_until({"head"}, set())
            if self.tag[self.open[-1]] == "p":
                self.shut(len(self.open) - 1)
            if tag in _CLOSES:
                self.close_until(*_CLOSES[tag])
            if tag == "main":
                first = next((d for d, i in enumerate(self.open) if self.cut[i]), None)
                if first is not None:
                    self.shut(first)
            self.links, self.tags = 0 if tag in _BORDERS - _PARAGRAPHS else self.links, self.tags + 1
        above, gone, cued, role = self.open[-1], tag in _CUT or tag == "header", tag == "form", ""
        if attrs:
            given = dict(attrs)
            role = (given.get("role") or "").lower()
            gone = gone or role in _CUT_ROLES or "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or bool(_HIDING.search(given.get("style") or ""))
            cued = cued or tag != "body" and _cued(given)
        if self.tag[above] == "header" and tag in _HEADINGS and any(self.chief[i] for i in self.open):
            gone = gone or self.cut[self.open[-2]]
        else:
            gone = gone or self.cut[above]
        self.parent.append(above)
        self.tag.append(tag)
        self.chief.append(tag in ("article", "main") or role == "main")
        self.cut.append(gone)
        self.cued.append(cued)
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        tag = "td" if tag == "th" else tag
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "td":
            self.parts.append(" ")
        if tag in _BLOCKS and tag not in ("html", "body") or tag in _SILENT:
            for depth in range(len(self.open) - 1, 0, -1):
                at = self.tag[self.open[depth]]
                if at == tag:
                    return self.shut(depth)
                if tag in _SILENT and at in _BLOCKS:
                    return

    def handle_data(self, data):
        if self.tag[self.open[-1]] not in _SILENT:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def _within(parent: list[int], flags: list[bool]) -> np.ndarray:
    """For each element whether it or one around it has the flag."""
    out = list(flags)
    for i in range(1, len(parent)):  # parents come first
        out[i] = out[i] or out[parent[i]]
    return np.array(out, bool)


def _sums(parent: list[int], at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.bincount(at, value, len(parent)).tolist()
    for i in range(len(parent) - 1, 0, -1):
        out[parent[i]] += out[i]
    return np.array(out)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel / kernel.sum())[reach : reach + len(ratio)]


def main_blocks(html: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    page = _Page()
    for i in range(0, len(html), FEED):
        page.feed(html[i : i + FEED])
    page.close()
    page.flush()
    if not page.lines:
        return []
    at, texts, tags, linked = zip(*page.lines, strict=True)
    at, tags, linked = np.array(at), np.array(tags), np.array(linked)
    size, parent = np.array([len(t) for t in texts]), page.parent
    chief, cut = np.array(page.chief), np.array(page.cut)
    if any(page.cued):  # a cue is wrong where it covers an article of its own that holds most of the text
        cued, shown = np.array(page.cued), size * ~cut[at]
        own = np.flatnonzero(chief & ~cued & ~cut)
        covers = _sums(parent, own, np.ones(len(own)))
        covers[own] -= 1
        cut |= _within(parent, (cued & ~((covers > 0) & (2 * _sums(parent, at, shown) > shown.sum()))).tolist())
    shown = (size > 0) & ~cut[at]
    if not shown.any():
        return []
    ratio = smoothed(np.where(shown, np.maximum(size - linked, 0) / np.maximum(tags, 1), 0))
    content = shown & (ratio >= ratio.std())
    mass = _sums(parent, at, size * content)
    chosen = [i for i in np.flatnonzero(chief & ~cut) if 2 * mass[i] >= mass[0]]  # outer ones come first
    if chosen:
        region = next((i for i in chosen if page.tag[i] == "article"), chosen[0])
        here = _within(parent, [i == region for i in range(len(parent))])[at] & shown
        return [t for t, keep in zip(texts, here, strict=True) if keep]
    lines_in = _sums(parent, at, shown)
    holder = max(i for i in range(len(parent)) if i == 0 or page.tag[i] in _HOLDERS and mass[i] >= MOST * mass[0] and lines_in[i] >= min(2, lines_in[0]))
    here = _within(parent, [i == holder for i in range(len(parent))])[at] & shown
    spots = np.flatnonzero(here & content)
    if not len(spots):
        return []
    order = np.flatnonzero(here)
    first, last = np.searchsorted(order, [spots[0], spots[-1]])
    text_like = np.array([page.tag[i] in _PARAGRAPHS for i in at]) & (2 * linked < size)
    while first > 0 and text_like[order[first - 1]]:
        first -= 1
    while last + 1 < len(order) and text_like[order[last + 1]]:
        last += 1
    return [texts[i] for i in order[first : last + 1]]


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of pages with text and n_chars (its code points); the other columns stay, but for these two, which are replaced.

    White space inside a block becomes one space, blocks are trimmed and joined by two line feeds; <br> is white space,
    cells of a table's row are one block. Headings of an article's own header stay, the rest of that header goes. Null
    html counts as empty; pages without content have an empty text. Repeated rows each get one; no rows give no rows.
    Broken markup is read as browsers do it in the usual cases: ends that nothing has opened are passed over, paragraphs,
    items and cells end with the next one, and what is cut off ends with the page. Long pages are read whole, a row at
    a time.
    """
    small_batches(pages.sparkSession, 200)
    (source,) = spare(pages, "__html")
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array(["\n\n".join(main_blocks(x.as_py())) for x in b.column(b.num_columns - 1)], pa.string())
            sizes = pa.array([len(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts, sizes], [*names, "text", "n_chars"])

    schema = StructType([*(StructField(f.name, f.dataType) for f in kept), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*(pages[f"`{n}`"] for n in names), text_or_empty(html_col).alias(source)).mapInArrow(run, schema)
