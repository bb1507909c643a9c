"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clusters.

1. The standard library's parser is fed a page in pieces. Its events become lines, one a block of
   text, each with its characters, its tags and the section it is in. Scripts, styles, menus, headers,
   footers and form controls, by their element, have no lines that count.
2. A line's ratio is its characters by its tags. Ratios are smoothed with a Gaussian kernel over
   the lines around. A line seeds content if its ratio and its smoothed ratio reach SEED of their
   means, and its cluster goes on over lines of running text whose smoothed ratio, which long
   neighbours lift, reaches THRESHOLD of the mean.
3. The clusters decide the region: the smallest container that holds all of them and the title before
   them. Every line of the region stays, so short paragraphs between long ones are kept. Where the
   region is the page itself, it ends with the running text next to the first and last cluster.
4. Elements and names break what ties the clusters leave: a ``main`` or ``article`` with most of the
   seeds' characters is the region; sections whose whole class, id or role says that they are adverts,
   notices, menus, sidebars or comments are left out, unless nearly all text is in them (comments
   always). Weaker names, and an ``aside`` or ``menu`` in an article, say so only of sections that hold no seed.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one line feed. Pages are read where they lie, without a shuffle, one at a time.
Sums over sections are made once, from the innermost out, so the work is linear in the page however long or
deeply nested it is, and nothing of it is cut. Null, empty and malformed pages give what text they have, at
least an empty string; a page whose text is all menus gives an empty string. Repeated rows give equal
rows, other columns are not read whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Shares of the mean: of the ratio and the smoothed ratio that a line needs to seed content, and of the
#: smoothed ratio that running text needs to go on from a seed.
SEED = 1.0
THRESHOLD = 0.5
PIECE = 1 << 16

# fixed values: elements of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = set("head script style noscript template svg math iframe object canvas audio video map nav header footer button select textarea dialog".split())
#: Sidebars outside an article; in one, what weak names are.
ASIDES = {"aside", "menu"}
MAIN = {"main", "article"}
#: What can be the content region; a paragraph, item, cell, quote or heading is a part of one.
CONTAINERS = {"", "html", "body", "main", "article", "section", "div", "form", "center", "fieldset", "details", "table"}
PAGE = {"", "html", "body"}
#: Blocks of running text: at a page's edges they go on from the seeds next to them.
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd td figcaption".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KEEPS_P = ("td", "th", "div", "article", "section", "main", "body", "li")
#: Words of class names, ids and roles.
COMMENT_NAMES = set("comment comments commentlist discussion disqus reply replies respond".split())
STRONG_NAMES = COMMENT_NAMES | set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar complementary contentinfo footer masthead topbar toolbar "
    "subscribe subscription newsletter signup login popup modal overlay pagination pager copyright".split())
WEAK_NAMES = set("aside widget social share sharing related recommended recommendations search searchform skip".split())
#: What may stand beside such a word in one name.
NEUTRAL_NAMES = set("area articles bar block body bottom box buttons container form header icons inner item items left links list main outer posts right section stories thread top wrap wrapper".split())
#: Outside an article.
OUTSIDE_NAMES = {"header", "head"}
#: Share of all text that makes a section of a strong name no side of the page, and that of a form.
NEARLY_ALL, MOST = 0.9, 0.5
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _said(value: str, outside: bool) -> set[str]:
    """The side words of a class, id or role, of those of its names that consist of such words."""
    out: set[str] = set()
    for name in value.split():
        words = {x.lower() for x in _NAME.findall(_CAMEL.sub(" ", name))}
        side = words & (STRONG_NAMES | WEAK_NAMES | (OUTSIDE_NAMES if outside else set()))
        if side and words <= side | NEUTRAL_NAMES:
            out |= side
    return out


class _Section:
    """A section, by its place in the page's order: those inside come later."""

    __slots__ = ("dropped", "main", "number", "parent", "side", "tag")

    def __init__(self, number: int, tag: str, parent: int, dropped: bool, main: bool, side: str = ""):
        self.number, self.tag, self.parent, self.dropped, self.main, self.side = number, tag, parent, dropped, main, side


class _Events(HTMLParser):
    """Lines of a page: text, tags, and the section each is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        root = _Section(0, "", -1, False, False)
        self.sections = [root]
        self.open = [root]
        #: Where each element, and where any block, is open.
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.lines: list[tuple[str, int, _Section]] = []
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.open[-1]))
        self.parts, self.tags = [], 0

    def _kind(self, tag: str, attrs: list) -> tuple[bool, str]:
        """Whether a section has no lines that count, and what its names say: strong, weak or form."""
        here = self.open[-1]
        if tag in DROPPED:
            # the header of an article holds its title
            return not (tag == "header" and here.main), ""
        if tag in ("html", "body"):
            return False, ""
        if tag in ASIDES and not here.main:
            return True, ""
        said: set[str] = {"aside"} if tag in ASIDES else set()
        for key, value in attrs:
            if not value and key == "hidden":
                return True, ""
            if key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True, ""
            if key == "aria-hidden" and value == "true" and tag not in INLINE:
                return True, ""
            if value and key in ("class", "id", "role"):
                said |= _said(value, not here.main)
        if said & COMMENT_NAMES:
            return True, ""
        if tag == "main" or not said:
            return False, "form" if tag == "form" else ""
        return False, "strong" if said & (STRONG_NAMES | OUTSIDE_NAMES) else "weak"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.tags += 1
            return
        if tag not in INLINE:
            self.end_line()
            if tag in CLOSES_P and self._last("p") > max(map(self._last, KEEPS_P)):
                self._close(self._last("p"))
        self.tags += 1
        if tag in VOID:
            return
        here = self.open[-1]
        dropped, side = self._kind(tag, attrs)
        section = _Section(len(self.sections), tag, here.number, here.dropped or dropped, here.main or tag in MAIN, side)
        self.sections.append(section)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append(section)

    def _last(self, tag: str) -> int:
        """Where the element was opened last and is open, or 0."""
        return (self.places.get(tag) or [0])[-1]

    def _close(self, at: int) -> None:
        """Closes what was opened at that place and since."""
        while len(self.open) > at:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.end_line()
            if self._last(tag):
                self._close(self._last(tag))
            return
        self.tags += 1
        # an inline end tag does not end the block around it
        if self._last(tag) > self.blocks[-1]:
            self._close(self._last(tag))

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian kernel of three sigmas over the lines, normalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach:reach + len(x)]
    return full(ratio) / full(np.ones(len(ratio)))


def _sums(sections: list[_Section], own: np.ndarray) -> np.ndarray:
    """Of each section what it and all inside hold: from the innermost out."""
    out = own.tolist()
    for s in reversed(sections[1:]):
        out[s.parent] += out[s.number]
    return np.array(out)


def _inside(sections: list[_Section], chosen: np.ndarray) -> np.ndarray:
    """Whether each section is one of the chosen or inside one."""
    out = chosen.tolist()
    for s in sections[1:]:
        out[s.number] = out[s.number] or out[s.parent]
    return np.array(out, bool)


def clusters(ratio: np.ndarray, text: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines that seed content, and those of their clusters: running text that goes on from a seed
    while the smoothed ratio stays over the lower threshold. text, running: lines that are such."""
    level = smooth(ratio)
    seed = text & (level >= SEED * level.mean()) & (ratio >= SEED * ratio[text].mean())
    if not seed.any():
        seed = text
    grown = seed.copy()
    at = np.flatnonzero(text)
    joins = (running & (level >= THRESHOLD * level.mean()))[at].tolist()
    for order in (range(len(at)), reversed(range(len(at)))):
        before = False
        for k in order:
            before = bool(grown[at[k]]) or (before and joins[k])
            grown[at[k]] = before
    return seed, grown


def main_text(html: str | None) -> str:
    """The article of one page."""
    if not html:
        return ""
    reader = _Events()
    html = re.sub(r"<!\[(?!CDATA\[)", "&lt;![", html)
    for at in range(0, len(html), PIECE):
        reader.feed(html[at:at + PIECE])
    reader.close()
    reader.end_line()
    lines, sections = reader.lines, reader.sections
    size = np.array([len(text) for text, _, _ in lines], float)
    where = np.array([s.number for _, _, s in lines], np.int64)
    usable = (size > 0) & ~np.array([s.dropped for _, _, s in lines], bool)
    if not usable.any():
        return ""
    n = len(sections)
    tag = np.array([s.tag for s in sections], object)
    side = np.array([s.side for s in sections], object)
    # strong names: sections that do not hold nearly all text
    held = _sums(sections, np.bincount(where, size * usable, n))
    out = (side == "strong") & (held <= NEARLY_ALL * held[0]) | (side == "form") & (held <= MOST * held[0])
    usable &= ~_inside(sections, out)[where]
    if not usable.any():
        return ""
    ratio = size / np.array([max(tags, 1) for _, tags, _ in lines], float)
    running = np.array([s.tag in RUNNING for _, _, s in lines], bool)
    seed, cluster = clusters(ratio, usable, running)
    mass = _sums(sections, np.bincount(where, size * seed, n))
    # weak names: sections without a seed
    usable &= ~_inside(sections, (side == "weak") & (mass == 0))[where]
    region = _region(sections, tag, where, usable, cluster, mass)
    keep = usable & _inside(sections, np.arange(n) == region)[where]
    if tag[region] in PAGE:
        keep &= _going_on(keep, cluster, running)
    return "\n".join(lines[i][0] for i in np.flatnonzero(keep).tolist())


def _region(sections: list[_Section], tag: np.ndarray, where: np.ndarray, usable: np.ndarray, cluster: np.ndarray, mass: np.ndarray) -> int:
    """The smallest container of all clusters and the title before them; or the main or article that has
    most of the seeds' characters, the outermost of several that have as many."""
    main = np.flatnonzero(np.isin(tag, list(MAIN)) & (2 * mass > mass[0]))
    if len(main):
        return int(main[mass[main] == mass[main].max()][0])
    needed = cluster.copy()
    first = int(np.flatnonzero(cluster)[0])
    title = np.flatnonzero(usable[:first] & _inside(sections, tag == "h1")[where[:first]])
    if len(title):
        needed[title[-1]] = True
    count = _sums(sections, np.bincount(where[needed], minlength=len(sections)))
    # all that hold every one lie in each other, so the last is the innermost
    return int(np.flatnonzero((count == needed.sum()) & np.isin(tag, list(CONTAINERS)))[-1])


def _going_on(keep: np.ndarray, cluster: np.ndarray, running: np.ndarray) -> np.ndarray:
    """From the first cluster to the last, and the blocks of running text next to them."""
    out = np.zeros(len(keep), bool)
    at = np.flatnonzero(keep)
    place = np.flatnonzero(cluster[at])
    first, last = (int(place[0]), int(place[-1])) if len(place) else (0, len(at) - 1)
    while first > 0 and running[at[first - 1]]:
        first -= 1
    while last < len(at) - 1 and running[at[last + 1]]:
        last += 1
    out[at[first:last + 1]] = True
    return out


def _extractor():
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return F.arrow_udf(extract, "string").asNondeterministic()


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    found = pages.select("page_id", "url", _extractor()("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
