"""Main text of web pages from streaming parser events.

The standard library's HTML parser streams tag and text events. They are cut into lines, one for each
block element. Each line has a text-to-tag ratio (characters for each tag seen since the last line); the
ratios are smoothed with a Gaussian along the page (and held against their own values), weighted by where
the line stands, and split into two clusters. The lines of the upper cluster are seeds, and they select regions:

- a region (article, section, division, cell) that holds a seed is content, with the unmarked regions in it
  that are not made of links; so short paragraphs of an article stay;
- so are its siblings of the same kind (articles of a page, divisions of the same class), unless they are
  marked or made of links, and the article or main element around it;
- a heading directly before a line of content is content.

The weights: an article or main element counts more, and a word of a compound class, id or role that calls
an element a menu, notice, advert or comment makes it count less. Elements that are never main text
(navigation, forms, scripts, and those whose whole class, id or role is such a word) weigh nothing and are
passed over while parsing, article and main elements excepted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
REGIONS = frozenset("article body div main section td".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id or role that marks what is not main text: the whole name weighs nothing, a word of a compound little.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie"
    " cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup"
    " promo promotion related remark remarks reply replies responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
WORDS = re.compile(r"[a-z]+")
#: Weights of lines in an article or main element, and in an element with a marked compound.
ROOT, MARKED = 3.0, 0.3
#: Share of link characters from which on a region is made of links.
LINKS = 0.5
SIGMA = 1.5
RADIUS = 4
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]


@dataclass
class Region:
    parent: int
    depth: int  # of the element in the stack
    kind: tuple[str, str]
    weight: float
    marked: bool
    chars: int = 0
    links: int = 0


@dataclass
class Line:
    text: str
    tags: int
    region: int
    heading: bool


class Lines(HTMLParser):
    """Collects the lines of a page and the tree of its regions."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[str] = []
        self.regions = [Region(-1, -1, ("", ""), 1.0, False)]
        self.open = [0]  # the regions around this place
        self.root: int | None = None  # depth of the outermost article or main element
        self.skip: int | None = None  # depth of the element that is passed over
        self.weak = False  # whether an article or main element ends the passing over
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0  # depth of open links
        self.linked = 0  # characters of the line in links
        self.heading = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(Line(text, self.tags, self.open[-1], self.heading))
                for k in self.open:
                    self.regions[k].chars += len(text)
                    self.regions[k].links += min(self.linked, len(text))
                self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.heading = tag in HEADINGS
        elif tag == "br" and self.skip is None:
            self.parts.append(" ")
        if tag in VOID:
            return
        named = {t for k, v in attrs if k in ("class", "id", "role") and v for t in v.lower().split()}
        plain = tag in ROOTS or tag in ("html", "body")
        marked = not plain and not MARKS.isdisjoint(named)
        partly = not plain and any(not MARKS.isdisjoint(WORDS.findall(t)) for t in named)
        if tag in ROOTS and self.skip is not None and self.weak:
            del self.stack[self.skip :]  # an unclosed menu or header before the article
            self.skip = None
        self.stack.append(tag)
        depth = len(self.stack) - 1
        if self.skip is not None:
            return
        if marked or tag in SKIPPED or (tag == "header" and self.root is None):
            self.skip, self.weak = depth, tag in ("nav", "header", "menu", "form")
            return
        self.links += tag == "a"
        if tag in ROOTS and self.root is None:
            self.root = depth
        if tag in REGIONS or partly and tag in BLOCKS:
            above = self.regions[self.open[-1]].weight
            name = next((v for k, v in attrs if k == "class" and v), "") if tag not in ROOTS else ""
            weight = max(above, ROOT) if tag in ROOTS else above * MARKED if partly else above
            self.regions.append(Region(self.open[-1], depth, (tag, name), weight, partly))
            self.open.append(len(self.regions) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.heading = False
        if tag in VOID or tag not in self.stack:
            return
        depth = len(self.stack) - 1 - self.stack[::-1].index(tag)
        if self.skip is not None and depth < self.skip and tag not in ("article", "main", "body", "html", "div", "section"):
            return  # a stray end tag does not end what is passed over
        gone = self.stack[depth:] if self.skip is None else self.stack[depth : self.skip]
        self.links = max(0, self.links - gone.count("a"))
        del self.stack[depth:]
        if self.skip is not None and self.skip >= depth:
            self.skip = None
        if self.root is not None and self.root >= depth:
            self.root = None
        while len(self.open) > 1 and self.regions[self.open[-1]].depth >= depth:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.skip is None:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        near = range(max(0, i - RADIUS), min(len(values), i + RADIUS + 1))
        weights = [KERNEL[abs(i - j)] for j in near]
        out.append(sum(w * values[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters: the mean of their means, from the extremes on until it stands."""
    cut = (min(values) + max(values)) / 2
    for _ in range(20):
        low = [v for v in values if v < cut]
        high = [v for v in values if v >= cut]
        if not low:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def ratios(lines: list[Line]) -> list[float]:
    """Text-to-tag ratios, each as the geometric mean of its own value and the one smoothed along the page: a
    stray word beside a long paragraph is no long paragraph."""
    own = [len(x.text) / max(1, x.tags) for x in lines]
    return [math.sqrt(a * b) for a, b in zip(own, smoothed(own), strict=True)]


def content_regions(lines: list[Line], regions: list[Region], scores: list[float]) -> set[int]:
    """The regions that the lines of the upper cluster select."""
    cut = threshold(scores)
    seeds = {x.region for x, r in zip(lines, scores, strict=True) if r >= cut}
    closed = [r.marked or r.links > LINKS * r.chars for r in regions]
    content = set(seeds)
    for k in seeds:  # the article or main element around a seed, if nothing marked lies between
        at = k
        while at > 0 and not regions[at].marked:
            at = regions[at].parent
            if regions[at].kind[0] in ROOTS:
                content.add(at)
    kinds = {(regions[k].parent, regions[k].kind) for k in content if not regions[k].marked}
    for k, r in enumerate(regions):  # a parent comes before its children
        if not closed[k] and (r.parent in content or k and (r.parent, r.kind) in kinds):
            content.add(k)
    return content


def main_text(html: str) -> str:
    """The main text of a page: its blocks in page order, one a line; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, regions = parser.lines, parser.regions
    if not lines:
        return ""
    content = content_regions(lines, regions, [r * regions[x.region].weight for x, r in zip(lines, ratios(lines), strict=True)])
    kept = [x.region in content for x in lines]
    for i in range(len(lines) - 2, -1, -1):
        kept[i] = kept[i] or lines[i].heading and kept[i + 1]
    return "\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        texts = [main_text(h or "") for h in b.column("html").to_pylist()]
        sizes = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages`` (page_id, url, html).

    A null or empty html, and a page of which nothing is main text, give an empty text; repeated rows
    each give a row; other columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
