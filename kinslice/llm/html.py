"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Text is split into lines at block elements;
a line's ratio is its length over the number of tags in it. Ratios are smoothed with a Gaussian
kernel and clustered by a threshold, their standard deviation over the page: lines above it, wherever
they stand, are the seeds of content. Tags only widen what the ratios choose and keep out boilerplate. A
seed's region is the article (else the main element, else the innermost block) around it; articles
beside a chosen one, under the same parent, and lines between chosen ones are chosen too. So short
paragraphs of an article stay. A block around articles or a main element gives only lines of its own.
Lines under elements that the markup names as navigation, headers, footers, sidebars, notices, adverts,
forms or comments are never chosen.
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

from . import common

SIGMA, RADIUS = 1.0, 2
KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
KERNEL /= KERNEL.sum()

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
EXCLUDED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input map menu nav noscript "
    "object option picture script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars "
    "widget widgets nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "disqus replies reply respond related recommended recommendations trending pagination pager toolbar copyright disclaimer".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
ABOUT = frozenset("has with no without is".split())
#: Whitespace of HTML and what character references decode to.
_BLANK = re.compile(r"\s+")
_CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Blocks that a seed outside articles and main elements stands for.
CONTAINERS = frozenset(["div", "section", "td", "body", "html"])
_SCOPE = frozenset("article main section div ul ol dl table tbody thead tfoot body html nav aside header footer form blockquote".split())


def _named(attrs: list[tuple[str, str | None]], only: frozenset) -> bool:
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.lower().split():
                words = re.split(r"[^a-z0-9]+", name)
                if not ABOUT & set(words) and only & set(words):
                    return True
        elif key == "role" and value and only is NAMES and value.strip().lower() in ROLES:
            return True
    return False


class Block:
    """An open or closed block element; what a line needs of the blocks around it is known when it opens."""

    __slots__ = ("article", "box", "kind", "main", "number", "up")

    def __init__(self, number: int, kind: str, up: Block | None):
        self.number, self.kind, self.up = number, kind, up
        #: the outermost article and main element, and the innermost container
        self.article = (up.article if up else None) or (self if kind == "article" else None)
        self.main = (up.main if up else None) or (self if kind == "main" else None)
        self.box = self if kind in CONTAINERS else up.box if up else None

    def own(self) -> Block | None:
        """The block whose text a line in this one belongs to."""
        return self.article or self.main or self.box


class Lines(HTMLParser):
    """Lines of a page in order: text, tags, whether it is excluded, and the innermost block around it.

    Memory and time are linear in the page, however deep its elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, Block | None]] = []
        self.open: list[tuple[str, bool, Block | None]] = []  # tag, excluded, innermost block
        self.count: Counter[str] = Counter()  # open tags
        self.words: list[str] = []
        self.tags = 0
        self.blocks: list[Block] = []

    def _end_line(self) -> None:
        if self.words:
            line = _BLANK.sub(" ", "".join(self.words)).strip()
            if line:
                _, excluded, block = self.open[-1] if self.open else ("", False, None)
                self.lines.append((line, self.tags, excluded, block))
            self.words = []
            self.tags = 0

    def _shut(self, k: int) -> None:
        for tag, _, _ in self.open[k:]:
            self.count[tag] -= 1
        del self.open[k:]

    def _push(self, tag: str, excluded: bool, block: Block | None) -> None:
        self.count[tag] += 1
        self.open.append((tag, excluded, block))

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br":
                self.words.append(" ")
            self.tags += 1
            if tag not in VOID:
                _, excluded, block = self.open[-1] if self.open else ("", False, None)
                self._push(tag, excluded, block)
            return
        self._end_line()
        self.tags += 1
        shut = _CLOSED_BY.get(tag)
        if shut and any(self.count[t] for t in shut):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in shut:
                    self._shut(k)
                    break
                if self.open[k][0] in _SCOPE:
                    break
        if tag in VOID:
            return
        _, excluded, up = self.open[-1] if self.open else ("", False, None)
        if not excluded:
            if tag in ("article", "main", "body", "html"):
                excluded = _named(attrs, COMMENTS) and tag == "article"
            elif tag == "header":
                excluded = up is None or not (up.article or up.main)
            else:
                excluded = tag in EXCLUDED or _named(attrs, NAMES)
        block = Block(len(self.blocks), tag, up)
        self.blocks.append(block)
        self._push(tag, excluded, block)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self._shut(k)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data):
        self.words.append(data)


def ratios(lines: list[tuple[str, int, bool, Block | None]]) -> np.ndarray:
    """Smoothed text-to-tag ratios."""
    raw = np.array([len(line) / max(tags, 1) for line, tags, _, _ in lines])
    padded = np.concatenate([np.repeat(raw[:1], RADIUS), raw, np.repeat(raw[-1:], RADIUS)])
    return np.convolve(padded, KERNEL, "valid")


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, joined by two newlines; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page._end_line()
    usable = np.array([not excluded for _, _, excluded, _ in page.lines], bool)
    if not usable.any():
        return ""
    within = [block for _, _, _, block in page.lines]
    smooth = ratios(page.lines)
    seeds = usable & (smooth >= min(smooth.std(), smooth[usable].max()))
    # the block that a line belongs to; None, the page, if nothing is around it
    own = [b.own() if b else None for b in within]
    regions = {own[k] for k in np.flatnonzero(seeds)}
    semantic = {own[k] for k in np.flatnonzero(usable) if own[k] is not None and own[k].kind in ("article", "main")}
    around: set[Block | None] = {None} if semantic else set()
    for m in semantic:
        up = m.up
        while up is not None and up not in around:
            around.add(up)
            up = up.up
    # articles beside a chosen one, under the same parent, belong to it
    shown = set(within)
    for block in reversed(page.blocks):  # blocks with lines, and those around them
        if block in shown and block.up is not None:
            shown.add(block.up)
    beside = {r.up for r in regions if r is not None and r.kind == "article"}
    regions |= {b for b in page.blocks if b.kind == "article" and b in shown and b.up in beside}
    # a block around articles gives its own lines, any other all that is in it
    whole = regions - around | {r for r in regions if r is not None and r.kind == "main"}
    inside = set()
    for block in page.blocks:
        if block in whole or block.up in inside:
            inside.add(block)
    kept = np.array([o in regions or o not in semantic and (None in whole or b in inside) for o, b in zip(own, within, strict=True)]) & usable
    # lines between chosen ones are chosen too
    at = np.flatnonzero(kept)
    kept[at[0] : at[-1]] = usable[at[0] : at[-1]]
    return "\n\n".join(page.lines[k][0] for k in np.flatnonzero(kept))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page.

    Null and empty html, and pages that are all markup, have an empty text. Pages cut off anywhere
    give what stands before the cut. Null ids and urls and repeated rows are kept as they are; other
    columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    common.arrow_ready(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
