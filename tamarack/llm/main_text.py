"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page's events. Text up to a block's begin or end is a line, with its white space
(as ``str.split`` has it, no-break spaces too) turned into one space; a line break element and table cells are white space.
A line's ratio is its characters outside links by the tags since the line before. Ratios are smoothed with a Gaussian of
one line's width; lines at or above the smoothed ratios' standard deviation are the content cluster.

Left out always: comments, scripts, styles, forms, menus, footers, sidebars, embedded and hidden elements, and headers that
aren't an article's own. Elements whose class, id or role names such a part, an advert, a notice or reader comments are left out
unless they wrap the page's only article or main element and over half of its text.

The content region is the page's articles (or its main element) if a fifth of the cluster's characters lies in them or the
cluster is empty; nothing shown is dropped there, however short. Pages without them: the deepest container with four
fifths of the cluster that leaves behind no heading and no line above the threshold; there lines from the first to the last of the cluster are
taken, and headings right before, but for lines that are mostly links.

A tag, comment or script that the page's end cuts off is no text, a cut-off reference is as it stands. Null or empty pages
and pages without content have an empty text. Repeated rows are pages of their own. Other columns are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed values of HTML: elements that begin a new line, that hold nothing, and that show no text of the page itself.
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br td th".split())
HIDDEN = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map math menu nav noframes noscript object script search select style svg template textarea title video".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id names that tell a part that isn't the article.
HINTS = re.compile(
    r"(?:ad|ads|adbox|adslot|adv|advert\w*|alert|banner|breadcrumb\w*|byline|colophon|consent\w*|cookie\w*|copyright|dfp|footer|footnav|gdpr|login|masthead|menu\w*|modal|nav|navbar|navigation|newsletter\w*|notice\w*"
    r"|notification\w*|overlay|pager|pagination|paywall|popup|promo\w*|recommend\w*|related|share|sharing|sidebar\w*|signup|sitehead\w*|skip|social\w*|sponsor\w*|subscri\w*|teaser\w*|toolbar|topbar|widget\w*)"
)
REMARKS = re.compile(r"(?:comment\w*|disqus\w*|discussion|replies|respond|reviews?)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SHOWN, HINTED, GONE = range(3)


def kind_of(tag: str, attributes: list, in_article: bool) -> tuple[int, bool]:
    """Whether an element's text is shown, left out by a hint, or gone; and whether it holds readers' remarks."""
    if tag in HIDDEN or tag == "header" and not in_article:
        return GONE, False
    hints = SHOWN
    for name, value in attributes:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return GONE, False
        if name == "role" and value.strip().lower() in ROLES and tag not in ("article", "main", "body", "html"):
            hints = HINTED
        if name in ("class", "id"):
            for word in _WORDS.findall(value):
                word = word.lower()
                if REMARKS.fullmatch(word) and tag not in ("body", "html", "main"):
                    return GONE, True
                if HINTS.fullmatch(word) and tag not in ("article", "main", "body", "html"):
                    hints = HINTED
    return hints, False


class Page(HTMLParser):
    """Collects a page's elements and its lines: for each the pieces of text with their element, and the tags before its end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.kinds, self.roots = ["html"], [0], [SHOWN], []
        self.stack, self.lines = [0], []
        self.pieces, self.count, self.links, self.articles, self.ending = [], 0, 0, 0, False

    def close(self):
        self.ending = True
        super().close()
        self.line()

    def _whole(self, end: int) -> int:
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_starttag(self, i):
        return self._whole(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._whole(super().parse_endtag(i))

    def parse_comment(self, i, report=1):
        return self._whole(super().parse_comment(i, report))

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):
            return self._whole(self.parse_bogus_comment(i))
        return self._whole(super().parse_html_declaration(i))

    def parse_pi(self, i):
        return self._whole(super().parse_pi(i))

    def line(self):
        if any(text.strip() for text, _, _ in self.pieces):
            self.lines.append((self.pieces, max(self.count, 1)))
            self.count = 0
        self.pieces = []

    def leave(self, depth: int):
        for node in self.stack[depth:]:
            self.links -= self.tags[node] == "a"
            self.articles -= self.tags[node] == "article"
        del self.stack[depth:]

    def end_open(self, tags, borders):
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in tags:
                return self.leave(depth)
            if tag in borders:
                return None

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if tag in BLOCKS:
            self.line()
            if tag != "tr":
                self.end_open({"p"}, {"table", "td", "th", "button", "caption", "object"})
        elif tag in SPACES:
            self.pieces.append((" ", self.stack[-1], False))
        if tag in ENDED_BY:
            self.end_open(*ENDED_BY[tag])
        if tag in VOID:
            return
        above = self.kinds[self.stack[-1]]
        kind, _ = (above, False) if above == GONE else kind_of(tag, attrs, self.articles > 0)
        node = len(self.tags)
        if kind == HINTED and above == SHOWN:
            self.roots.append(node)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.kinds.append(max(kind, above))
        self.stack.append(node)
        self.links += tag == "a"
        self.articles += tag == "article"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash of <div/> means nothing in HTML

    def handle_endtag(self, tag):
        self.count += 1
        if tag in BLOCKS:
            self.line()
        elif tag in SPACES:
            self.pieces.append((" ", self.stack[-1], False))
        for depth in range(len(self.stack) - 1, 0, -1):
            opened = self.tags[self.stack[depth]]
            if opened == tag:
                return self.leave(depth)
            if opened in BLOCKS and tag not in BLOCKS:
                return None

    def handle_data(self, data):
        node = self.stack[-1]
        if self.kinds[node] != GONE:
            self.pieces.append((data, node, self.links > 0))


def smooth(ratios: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at both ends the weights of the lines there are."""
    reach = np.arange(-int(3 * width), int(3 * width) + 1)
    kernel = np.exp(-(reach**2) / (2 * width * width))
    full = lambda x: np.convolve(x, kernel)[len(reach) // 2 :][: len(ratios)]
    return full(ratios) / full(np.ones(len(ratios)))


def _inside(page: Page, chosen: set[int]) -> list[bool]:
    out = [0 in chosen]
    for node in range(1, len(page.tags)):
        out.append(node in chosen or out[page.parents[node]])
    return out


def _unwrap(page: Page) -> None:
    """Show hinted elements again that hold the only article and over half of the text."""
    if not page.roots:
        return
    mass, main = [0] * len(page.tags), [int(t in ("article", "main") and k != GONE) for t, k in zip(page.tags, page.kinds)]
    mains = sum(main)
    for pieces, _ in page.lines:
        for text, node, _ in pieces:
            mass[node] += len(text.strip())
    for node in range(len(page.tags) - 1, 0, -1):
        mass[page.parents[node]] += mass[node]
        main[page.parents[node]] += main[node]
    back = {r for r in page.roots if mains and main[r] == mains and 2 * mass[r] > mass[0]}
    hinted = set(page.roots)
    for node in range(1, len(page.tags)) if back else ():
        above = page.kinds[page.parents[node]]
        if node in back:
            page.kinds[node] = above
        elif page.kinds[node] == HINTED and above == SHOWN and node not in hinted:
            page.kinds[node] = SHOWN


def main_text(html: str | None) -> str:
    """The page's main text, one block in each line."""
    page = Page()
    page.feed(html or "")
    page.close()
    _unwrap(page)
    texts, owners, ratios, linked = [], [], [], []
    for pieces, tags in page.lines:
        shown = [p for p in pieces if page.kinds[p[1]] == SHOWN]
        text = " ".join("".join(t for t, _, _ in shown).split())
        in_links = len(" ".join("".join(t for t, _, link in shown if link).split()))
        texts.append(text)
        owners.append(next((n for t, n, _ in shown if t.strip()), 0))
        ratios.append(max(len(text) - in_links, 0) / tags)
        linked.append(2 * in_links > len(text))
    if not any(texts):
        return ""
    level = smooth(np.array(ratios, dtype=np.float64))
    threshold = float(level.std())
    content = [bool(t) and s >= threshold and r > 0 for t, s, r in zip(texts, level, ratios)]
    total = sum(len(t) for t, c in zip(texts, content) if c)
    for name in ("article", "main"):
        chosen = {n for n, t in enumerate(page.tags) if t == name and page.kinds[n] == SHOWN}
        inside = _inside(page, chosen)
        own = [t for t, o in zip(texts, owners) if t and inside[o]]
        if own and 5 * sum(len(t) for t, o, c in zip(texts, owners, content) if c and inside[o]) >= total:
            return "\n".join(own)
    return "\n".join(_region(page, texts, owners, ratios, linked, content, threshold))


def _region(page: Page, texts: list[str], owners: list[int], ratios: list[float], linked: list[bool], content: list[bool], threshold: float) -> list[str]:
    """The lines of the content cluster's container, from the cluster's first to its last line."""
    mass = [0] * len(page.tags)
    kept = [0] * len(page.tags)  # lines that may not be left behind
    headings = []
    for text, owner, ratio, c in zip(texts, owners, ratios, content):
        up = owner
        while up and page.tags[up] not in BLOCKS:
            up = page.parents[up]
        headings.append(page.tags[up] in HEADINGS)
        if text:
            mass[owner] += len(text) if c else 0
            kept[owner] += headings[-1] or ratio >= threshold > 0
    for node in range(len(page.tags) - 1, 0, -1):
        mass[page.parents[node]] += mass[node]
        kept[page.parents[node]] += kept[node]
    children: dict[int, list[int]] = {}
    for node in range(1, len(page.tags)):
        children.setdefault(page.parents[node], []).append(node)
    at = 0
    while True:
        deeper = [c for c in children.get(at, ()) if page.tags[c] in CONTAINERS and mass[c] and 5 * mass[c] >= 4 * mass[at] and kept[c] == kept[at]]
        if not deeper:
            break
        at = deeper[0]
    inside = _inside(page, {at})
    lines = [k for k, text in enumerate(texts) if text and inside[owners[k]]]
    of = [n for n, k in enumerate(lines) if content[k]]
    if not of:
        return []
    first = of[0]
    while first and headings[lines[first - 1]]:
        first -= 1
    return [texts[k] for k in lines[first : of[-1] + 1] if not linked[k]]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
