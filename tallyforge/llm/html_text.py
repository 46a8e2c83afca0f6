"""Main text of web pages by text-to-tag ratio.

A streaming parser turns a page into lines (one per block), each with its text, its number of
tags and links, and the container it stands in: the innermost element that is no part of a text, or the marked element
around it. The ratio of text to tags, less what is linked, is zero on lines of menus, notices, adverts, forms, sidebars, footers and
comments. The ratios are smoothed with a Gaussian along the lines, but not across the bounds of such marked parts, and cut by a
threshold on the deviation of the page's curve; a container is content if lines over the threshold hold half of its characters outside links, and a heading goes with the line
below it. The region is the smallest element that holds all content. Of its lines those stay whose smoothed
ratio is over zero, and plain link lines where the region is not the whole body. No element name selects a region.

Defined results: a null or empty page gives an empty text; unclosed, cut off and very long pages are
read to their end; equal ratios lie on the same side of the threshold; repeated rows are read each
on its own; an empty table gives no row; columns other than page_id, url and html are never read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, own_columns, texts

#: Width of the Gaussian in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, DEVIATIONS = 1.0, 0.5

#: Elements by their part in a page. Fixed values of the HTML standard.
HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map textarea select datalist".split())
ASIDE = frozenset("nav footer aside form button dialog menu fieldset label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text that are no region of their own; a cell may be one, where a table lays out the page.
PARTS = HEADINGS | frozenset("p pre a b i em strong span li ul ol dl dt dd blockquote figure figcaption address table caption thead tbody tfoot tr".split())
LIST_ITEMS = frozenset("li dt dd td th".split())
#: Elements whose end tag may be left out: what a start tag ends, and what it can't reach beyond.
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDS_LIKE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article section div body html main aside nav footer header form td th".split())
#: Words in class, id or role that mark an element as no content.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|masthead|menu|modal|nav|navbar|"
                    r"navigation|newsletter|notice|popup|promo\w*|related|reply|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|"
                    r"toolbar|widgets?|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """The lines of a page, built while its events come in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # name, number of the element, whether it is off the content, number of the innermost block, and of the container
        self.open: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        self.depths: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        self.hidden = 0
        self.parents = [-1]  # of each element
        self.named = [""]
        self.lines: list[tuple[str, int, int, int, int, bool]] = []  # text, tags, characters in links, element, container, off the content
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def _end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, _, off, element, container = self.open[-1]
            self.lines.append((text, self.tags, self.linked, element, container, off))
            self.tags = self.linked = 0
        self.parts = []

    def _close(self, depth: int) -> None:
        """End the elements from ``depth`` of the stack on."""
        ended = [entry[0] for entry in self.open[depth:]]
        for name in ended:
            self.in_link -= name == "a"
            self.hidden -= name in HIDDEN
        if any(name in BLOCKS for name in ended):
            self._end_line()
        for name in ended:
            self.depths[name].pop()
        del self.open[depth:]

    def _nearest(self, names, scopes) -> int:
        """Where the innermost open element of these names is, 0 if there is none above the innermost of the scopes."""
        innermost = lambda some: max((self.depths[n][-1] for n in some if self.depths.get(n)), default=0)
        depth = innermost(names)
        return depth if depth and depth >= innermost(scopes) else 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS or tag == "br":
            self._end_line()
        if tag in VOID:
            return
        if tag in ENDS_P and (depth := self._nearest({"p"}, SCOPES)):
            self._close(depth)
        if tag in ENDS_LIKE and (depth := self._nearest(ENDS_LIKE[tag], SCOPES - ENDS_LIKE[tag])):
            self._close(depth)
        _, parent, outside, block, container = self.open[-1]
        off = outside or tag in ASIDE or (tag == "header" and not self.depths.get("article") and not self.depths.get("main"))
        if not off and tag not in ("html", "body", "article", "main"):
            off = any(value and name in ("class", "id", "role") and MARKED.search(value) for name, value in attrs)
        off = bool(off) or any(name == "hidden" for name, _ in attrs)
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"
        number = len(self.parents)
        self.parents.append(parent)
        self.named.append(tag)
        own = (off and not outside) or (not off and tag in BLOCKS and tag not in PARTS)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, off, number if tag in BLOCKS else block, number if own else container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "p" and not self._nearest({"p"}, SCOPES):
            self._end_line()
            return
        scopes = frozenset(("body", "html")) if tag in SCOPES else SCOPES
        if depth := self._nearest({tag}, scopes):
            self._close(depth)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)

    def finish(self):
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means; at either end of the page over the lines that are there."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def main_text(html: str | None) -> str:
    """The text of the content region, one block per line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    ratios = np.array([0.0 if off else max(0, len(text) - 2 * linked) / (tags + 1) for text, tags, linked, _, _, off in lines])
    held: dict[int, list[int]] = {}  # lines by container
    for i, line in enumerate(lines):
        held.setdefault(line[4], []).append(i)
    marks = np.array([container if off else -1 for _, _, _, _, container, off in lines])
    curve = np.concatenate([smoothed(run) for run in np.split(ratios, np.flatnonzero(np.diff(marks)) + 1)])
    over = (curve > 0) & (curve >= DEVIATIONS * curve.std())
    size = np.array([max(0, len(text) - linked) for text, _, linked, _, _, _ in lines])
    content = np.zeros(len(lines), dtype=bool)
    for own in held.values():
        content[own] = 2 * size[own][over[own]].sum() >= max(1, size[own].sum())
    if not content.any():
        content = over
    if not content.any():
        return ""
    heads = False  # whether the next line that is not off the content is content
    for i in range(len(lines) - 1, -1, -1):
        if not lines[i][5]:
            heads = content[i] = content[i] or (heads and parser.named[lines[i][3]] in HEADINGS)
    region = holding(parser, {lines[i][3] for i in np.flatnonzero(content)})
    while parser.named[region] in PARTS:
        region = parser.parents[region]
    inside = within(parser, region)
    first, last = int(content.argmax()), len(lines) - 1 - int(content[::-1].argmax())
    whole_page = parser.named[region] in ("", "html", "body")

    def stays(i: int) -> bool:
        _, _, _, element, _, off = lines[i]
        listed = whole_page and not first <= i <= last and ratios[i] == 0 and parser.named[element] in LIST_ITEMS
        return inside[element] and (content[i] or (not listed and (curve[i] > 0 or not off)))

    return "\n".join(line[0] for i, line in enumerate(lines) if stays(i))


def holding(parser: Lines, elements: set[int]) -> int:
    """The smallest element that holds all of these; a parent has a lower number than its children."""
    below = dict.fromkeys(elements, 1)
    for element in range(len(parser.parents) - 1, 0, -1):
        if n := below.get(element):
            if n == len(elements):
                return element
            parent = parser.parents[element]
            below[parent] = below.get(parent, 0) + n
    return 0


def within(parser: Lines, top: int) -> list[bool]:
    """Whether each element is ``top`` or lies in it."""
    inside = [element == top for element in range(len(parser.parents))]
    for element in range(1, len(inside)):
        inside[element] = inside[element] or inside[parser.parents[element]]
    return inside


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page; one map without a shuffle."""

    def extracted(batch: pa.RecordBatch):
        found = [main_text(t.decode() if t is not None else None) for t in texts(batch.column("html"))]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return batches(own_columns(pages, "page_id", "url", "html"), extracted, "page_id long, url string, text string, n_chars long", _FIELDS)
