"""Main text of web pages: text-to-tag ratios per line, Gaussian smoothing and threshold clustering.

The standard-library parser streams over the markup. Every block of the page becomes a line with its
text and the tags met since the last one. The ratios of text to tags are smoothed along the page, and
two-means clustering puts a threshold between poor and rich lines. Elements that name themselves
something else (menu, footer, advert ...) lower the ratios of their lines to 0. Forms, dialogs, headers
and what only a class or id names are not believed where next to no prose would be left: a page that
stands in one form, or under a layout named after its sidebar, is not a form or a sidebar. The rich lines then pick the content regions: the articles, or else main parts, if
these hold most of the rich text; else the smallest element around all rich lines. A picked region is
kept whole, with its short lines, but for what is marked and for menus of links without rich text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import small_batches, text_of

# Element names and the words by which pages name what is not their article.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("audio canvas datalist head iframe math noscript object script select style svg template textarea title video".split())
OTHER = frozenset("aside button footer menu nav search".split())
OTHER_WRAPPERS = frozenset("dialog form header".split())
REGIONS = frozenset("article main section div td body".split())
NOT_ARTICLE = frozenset(
    "ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination popup promo promotion recommended related replies share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split())
# A class that begins with one of these says what an element has or lacks, not what it is.
MODIFIERS = frozenset("has have no non with without hide hides show shows enable enables disable disables toggle supports".split())
ROLES = frozenset("banner complementary contentinfo menu menubar navigation search toolbar".split())
WRAPPER_ROLES = frozenset("alert dialog form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# An end tag does not close elements beyond one of these.
FENCES = frozenset("article main section table td body".split())

FED = 1 << 16
"""Characters handed to the parser at a time."""

SIGMA = 1.0

LEFT = 0.05
"""Marks are believed as long as this share of the prose is left without them."""

PROSE = 100
"""Characters of prose that a marked element must hold to be taken for a wrapper of the article."""

MOST = 0.5
"""Share of the rich text that articles, or main parts, hold when they are the content."""

MENU = 3
"""So many poor lines of links in a row are a menu."""


@dataclass
class Line:
    """A block of text: the region and the mark it stands in, the tags met since the line before. ``linked``
    while all its text is link text, ``unseen`` where nothing is shown."""

    region: int
    mark: int
    unseen: bool = False
    heading: bool = False
    tags: int = 0
    linked: bool = True
    parts: list[str] = field(default_factory=list)


@dataclass
class Open:
    """An element that is open, with the innermost region and mark (-1: none) around its content."""

    name: str
    region: int
    mark: int
    unseen: bool


class Lines(HTMLParser):
    """Cuts a page into lines as the parser's events come in.

    Regions and marked elements are kept as trees, each entry with its parent; whatever the depth of the
    markup, an event costs the same.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = [Open("", 0, -1, False)]
        self.counts: Counter[str] = Counter()
        self.inside_fence: list[Counter[str]] = [Counter()]  # names open since the last fence
        self.regions: list[tuple[str, int]] = [("page", -1)]
        self.marks: list[tuple[int, bool]] = []  # parent, whether it may be a wrapper
        self.lines: list[Line] = []
        self.tags = 0
        self.current: Line | None = None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.current = None
        if tag == "br" and self.current is not None:
            self.current.parts.append(" ")
        if tag in EMPTY:
            return
        last, named = self.open[-1], dict(attrs)
        region, mark, unseen = last.region, last.mark, last.unseen or tag in UNSEEN or "hidden" in named
        kind = self._names_other(tag, named)
        if kind is not None:
            self.marks.append((mark, kind))
            mark = len(self.marks) - 1
        if tag in REGIONS and not unseen:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.open.append(Open(tag, region, mark, unseen))
        self.counts[tag] += 1
        if tag in FENCES:
            self.inside_fence.append(Counter())
        self.inside_fence[-1][tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _names_other(self, tag: str, attrs: dict) -> bool | None:
        """Whether an element that names itself something else may yet wrap the article; None if it does not."""
        role = (attrs.get("role") or "").lower()
        if tag in OTHER or role in ROLES or attrs.get("aria-hidden") == "true":
            return False
        if tag == "header" and (self.counts["article"] or self.counts["main"]):
            return None
        if tag in OTHER_WRAPPERS:
            return True
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return None
        if role in WRAPPER_ROLES:
            return True
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if words[0] not in MODIFIERS and not NOT_ARTICLE.isdisjoint(words):
                return True
        return None

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.current = None
        if not (self.counts if tag in FENCES else self.inside_fence[-1])[tag]:
            return  # nothing that it may close
        while True:
            closed = self.open.pop()
            self.counts[closed.name] -= 1
            if closed.name in FENCES:
                self.inside_fence.pop()
            else:
                self.inside_fence[-1][closed.name] -= 1
            if closed.name == tag:
                break

    def handle_data(self, data):
        if self.current is None:
            if not data.strip():
                return
            last = self.open[-1]
            self.current = Line(last.region, last.mark, last.unseen, any(self.counts[h] for h in HEADINGS))
            self.lines.append(self.current)
        if not self.counts["a"] and data.strip():
            self.current.linked = False
        self.current.parts.append(data)
        self.current.tags += self.tags
        self.tags = 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios after a Gaussian filter; its weights are scaled where it hangs over an end."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / over


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of numbers, by two-means from the extremes."""
    low, high = float(values.min()), float(values.max())
    while True:
        border = (low + high) / 2
        poor, rich = values[values <= border], values[values > border]
        if not len(poor) or not len(rich):
            return border
        again = float(poor.mean()), float(rich.mean())
        if again == (low, high):
            return border
        low, high = again


def rich_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the rich cluster of the smoothed ratios; all, where there is one cluster."""
    scores = smoothed(ratios)
    return scores >= threshold(scores)


def believed_marks(tree: list[tuple[int, bool]], marks: np.ndarray, text: np.ndarray, named: np.ndarray) -> list[bool]:
    """Which marks count, given the prose (text that is not all links) of every line, its innermost mark, and
    whether it stands in an article or main part.

    Marks that hold most of the prose lie inside one another. From the outside in, those that may be
    wrappers are disbelieved until enough of it stands under no believed mark: a share of it, or the prose
    of an article, which its comments may outweigh by far.
    """
    total = float(text.sum())
    held = np.zeros(len(tree))
    np.add.at(held, marks[marks >= 0], text[marks >= 0])
    own = held.copy()
    for i in range(len(tree) - 1, -1, -1):  # a parent comes before its children
        if tree[i][0] >= 0:
            held[tree[i][0]] += held[i]
    believed, blocked = [True] * len(tree), [False] * len(tree)
    free = float(text[marks < 0].sum())
    if text[(marks < 0) & named].sum() >= PROSE:
        return believed
    for i, (parent, wrapper) in enumerate(tree):
        if free >= LEFT * total:
            break
        if held[i] > total / 2 and held[i] >= PROSE and wrapper and not (parent >= 0 and blocked[parent]):
            believed[i] = False
            free += own[i]
        else:
            blocked[i] = True
    return believed


def under_mark(tree: list[tuple[int, bool]], believed: list[bool]) -> list[bool]:
    """Whether an element stands in a believed mark, itself included."""
    out: list[bool] = []
    for i, (parent, _) in enumerate(tree):
        out.append(believed[i] or (parent >= 0 and out[parent]))
    return out


def picked_regions(regions: list[tuple[str, int]], places: np.ndarray, rich: np.ndarray, text: np.ndarray) -> tuple[list[bool], bool]:
    """Which regions are content, themselves or as part of one, and whether these name themselves so.
    ``places``: the region of each line that may be content; the rich ones and their text decide."""
    held, lines, total = np.zeros(len(regions)), np.zeros(len(regions), dtype=int), float(text[rich].sum())
    np.add.at(held, places[rich], text[rich])
    np.add.at(lines, places, 1)
    for i in range(len(regions) - 1, 0, -1):
        held[regions[i][1]] += held[i]
        lines[regions[i][1]] += lines[i]
    outermost = {kind: _outermost(regions, kind) for kind in ("article", "main")}
    for kind in ("article", "main"):
        kept = [i for i in outermost[kind] if held[i] > 0]
        if kept and sum(held[i] for i in kept) >= MOST * total:
            return _within(regions, set(kept)), True
    # The smallest region around all rich lines; if that is a single line, the one around it.
    around, below = 0, _children(regions)
    while deeper := [c for c in below.get(around, ()) if held[c] >= total and held[c] > 0]:
        around = deeper[0]
    if around and lines[around] == 1:
        around = regions[around][1]
    return _within(regions, {around}), False


def _children(regions: list[tuple[str, int]]) -> dict[int, list[int]]:
    below: dict[int, list[int]] = {}
    for i, (_, parent) in enumerate(regions):
        below.setdefault(parent, []).append(i)
    return below


def _outermost(regions: list[tuple[str, int]], kind: str) -> list[int]:
    """Regions of a kind that lie in no other of it."""
    inside, out = [False] * len(regions), []
    for i, (name, parent) in enumerate(regions):
        above = parent >= 0 and inside[parent]
        inside[i] = above or name == kind
        if name == kind and not above:
            out.append(i)
    return out


def _within(regions: list[tuple[str, int]], picked: set[int]) -> list[bool]:
    out: list[bool] = []
    for i, (_, parent) in enumerate(regions):
        out.append(i in picked or (parent >= 0 and out[parent]))
    return out


def menus(poor_links: np.ndarray) -> np.ndarray:
    """Lines in runs of at least MENU poor lines of links."""
    found = np.zeros(len(poor_links), dtype=bool)
    start = 0
    while start < len(poor_links):
        end = start
        while end < len(poor_links) and poor_links[end]:
            end += 1
        if end - start >= MENU:
            found[start:end] = True
        start = end + 1
    return found


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none."""
    parser = Lines()
    for start in range(0, len(html), FED):
        parser.feed(html[start:start + FED])
    parser.close()
    lines = parser.lines
    texts = [" ".join("".join(line.parts).split()) for line in lines]
    shown = np.array([bool(text) and not line.unseen for line, text in zip(lines, texts)], dtype=bool)
    if not shown.any():
        return ""
    sizes = np.array([len(text) for text in texts], dtype=float)
    ratios = np.where(shown, sizes / np.maximum(1, [line.tags for line in lines]), 0.0)
    marks = np.array([line.mark for line in lines])
    own = _within(parser.regions, {i for i, (name, _) in enumerate(parser.regions) if name in ("article", "main")})
    named = np.array([own[line.region] for line in lines], dtype=bool)
    prose = shown & ~np.array([line.linked for line in lines], dtype=bool)
    believed = believed_marks(parser.marks, marks, np.where(prose, sizes, 0.0), named)
    marked = under_mark(parser.marks, believed)
    may = shown & ~np.array([m >= 0 and marked[m] for m in marks], dtype=bool)
    if not may.any():
        return ""
    rich = rich_lines(np.where(may, ratios, 0.0))
    at = np.flatnonzero(may)
    places = np.array([lines[i].region for i in at])
    telling = rich[at] if rich[at].any() else np.ones(len(at), dtype=bool)
    content, says_so = picked_regions(parser.regions, places, telling, sizes[at])
    poor_links = np.array([lines[i].linked and not lines[i].heading and not rich[i] for i in at], dtype=bool)
    # What calls itself the article may hold a line that is a link; elsewhere such lines are navigation.
    dropped = menus(poor_links) if says_so else poor_links
    return "\n".join(texts[i] for k, i in enumerate(at) if content[places[k]] and not dropped[k])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) instead of ``html``.

    No shuffle; each page is parsed by itself in one pass. A null or empty page has an empty text;
    markup that is not closed ends with the page; repeated rows stay.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    out = pages.withColumn("text", extracted(text_of(html)))
    return out.drop(html).withColumn("n_chars", F.length("text").cast("long"))
