"""Main content of web pages by text-to-tag ratio.

The events of the standard-library parser are streamed into lines, one for each
block of text. A line's ratio is its text against its tags; ratios are smoothed
by a Gaussian along the page and clustered into two by threshold, and the lines
above it are the content lines. They select the region: the innermost element
around the headline that holds lines of some ratio, or without headline the
element whose own lines weigh most among the content lines. A page whose lines
have no ratio has no main body, headline or not.

Structure draws the borders of the region around the content lines. Its own
lines belong to it, short ones and lists too, as cells, items and captions have
no ratio of their own; in a page without an element for the article, lists of
links only between content lines. Elements nested in it, at any depth, belong if
their text is for the greater part content lines, or is data (cells of a table,
code, captions). Furniture and teasers are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import latest

#: Elements removed with their content, and elements that do not end a block.
REMOVED = frozenset("head script style noscript template".split())
INLINE = frozenset("a abbr b code em i small span strong sub sup time".split())
#: Elements that can be a region, those that never are the article, and words in class or id that say so.
REGIONS = frozenset("body div section main article aside nav header footer form td th".split())
FURNITURE = frozenset("nav aside footer form header button menu dialog select".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert banner breadcrumb breadcrumbs consent cookie cookies crumbs footer menu more nav navbar navigation newsletter pager pagination popup promo related share sharing sidebar social sponsor subscribe tags teaser toolbar widget".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Deviation of the Gaussian in lines, and its reach.
SIGMA, REACH = 1.0, 3
#: Holders of data, whose short lines say nothing by their ratio; and the least number of cells of a table of data.
DATA, LEAST_CELLS = frozenset("td th pre caption figcaption".split()), 4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A line with this share of its text in links is a link.
LINK_SHARE = 0.9
#: Part of the border that some line around a headline must reach in its smoothed ratio.
LEAST_RATIO = 0.1


@dataclass(slots=True)
class Region:
    """An element that may hold an article; number 0 is the page."""

    parent: int
    tag: str
    furniture: bool
    has_blocks: bool = False
    table: int = 0


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    link_chars: int
    region: int
    holder: str
    list_no: int
    table: int = 0
    ratio: float = 0.0


class Lines(HTMLParser):
    """Collects the lines and regions of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = [Region(-1, "page", False)]
        #: open elements with their region: all but void and inline ones
        self.open: list[tuple[str, int]] = []
        self.region = 0
        self.removed = 0
        self.text: list[str] = []
        self.tags = self.link_chars = self.links = self.seen_tags = 0
        self.lists = self.list_no = 0
        #: open tables: depth and number
        self.tables: list[tuple[int, int]] = []
        self.seen_tables = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            holder = self.open[-1][0] if self.open else ""
            self.lines.append(Line(text, self.tags, self.link_chars, self.region, holder, self.list_no, self.tables[-1][1] if self.tables else 0))
        self.text, self.tags, self.link_chars = [], 0, 0

    def _close(self, upto: int) -> None:
        del self.open[upto:]
        while self.tables and self.tables[-1][0] >= upto:
            self.tables.pop()
        self.region = self.open[-1][1] if self.open else 0

    def _close_open(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``within`` lies inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._close(i)
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen_tags += 1
        if tag in INLINE:
            self.tags += 1
            self.links += tag == "a"
            return
        self.end_line()
        if tag == "body":
            self.removed = 0
        if tag in REMOVED:
            self.removed += 1
            return
        self.links = 0
        self.tags += 1
        if tag in VOID or self.removed:
            return
        if tag == "li":
            self._close_open(("li",), ("ul", "ol"))
        elif tag in ("td", "th"):
            self._close_open(("td", "th"), ("table",))
        elif tag == "tr":
            self._close_open(("tr",), ("table",))
        elif self.open and self.open[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._close(len(self.open) - 1)
        if tag in ("ul", "ol"):
            self.lists += 1
            self.list_no = self.lists
        if tag == "table":
            self.seen_tables += 1
            self.tables.append((len(self.open), self.seen_tables))
        if tag in REGIONS:
            # an element without blocks of its own is a line of the one around it
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower().replace("_", " ").replace("-", " ").split()
            furniture = self.regions[self.region].furniture or tag in FURNITURE or not FURNITURE_WORDS.isdisjoint(names)
            self.regions[self.region].has_blocks = True
            self.regions.append(Region(self.region, tag, furniture, table=self.tables[-1][1] if self.tables else 0))
            self.region = len(self.regions) - 1
        elif tag not in ("tr", "tbody", "thead", "tfoot"):
            self.regions[self.region].has_blocks = True
        self.open.append((tag, self.region))

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.end_line()
        if tag in REMOVED:
            self.removed = max(0, self.removed - 1)
            return
        self.links = 0
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                break
            if self.open[i][0] == "table" and tag not in REGIONS - {"td", "th"}:
                break
        if tag in ("ul", "ol"):
            self.list_no = 0

    def handle_data(self, data: str) -> None:
        if not self.removed:
            self.text.append(data)
            if self.links:
                self.link_chars += len("".join(data.split()))


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian mean along the lines; at the ends the weights that are left count."""
    kernel = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        part = [(w, ratios[i + d]) for w, d in zip(kernel, range(-REACH, REACH + 1)) if 0 <= i + d < len(ratios)]
        out.append(sum(w * r for w, r in part) / sum(w for w, _ in part))
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters of the values, by repeated means."""
    if not values:
        return 0.0
    low, high = min(values), max(values)
    border = (low + high) / 2
    for _ in range(30):
        left, right = [v for v in values if v < border], [v for v in values if v >= border]
        new = (sum(left) / len(left) + sum(right) / len(right)) / 2 if left and right else border
        if abs(new - border) < 1e-9:
            break
        border = new
    return border


def parse(html: str) -> Lines:
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return page


def main_lines(page: Lines) -> list[bool]:
    """For each block of a page, in order, whether it belongs to the main body."""
    lines, regions = page.lines, page.regions
    if not lines or not page.seen_tags:
        return [False] * len(lines)

    # a div or layout cell that holds nothing but text is a line of the element around it
    home = []
    for line in lines:
        at = line.region
        if not regions[at].has_blocks and regions[at].tag not in ("nav", "aside", "footer", "form") and at:
            if regions[at].tag in ("div", "td", "th") and not (regions[at].furniture and not regions[regions[at].parent].furniture):
                at = regions[at].parent
        home.append(at)

    full = [line.link_chars >= LINK_SHARE * len("".join(line.text.split())) for line in lines]
    smooth, border, content = content_lines(lines, full)
    if not any(content):
        return [False] * len(lines)
    # where furniture alone is above the border, any line with a ratio counts
    mass = _mass(lines, home, content, regions) or _mass(lines, home, [value > 0 and not link for value, link in zip(smooth, full)], regions)

    head = next((i for i, line in enumerate(lines) if line.holder == "h1"), None)
    region, kept = None, set()
    if head is not None:
        region = home[head]
        told = _around(regions, (at for at, value in zip(home, smooth) if value >= LEAST_RATIO * border))
        while region and (regions[region].tag == "header" or region not in told):
            region = regions[region].parent
        spoken = {at for at, line in zip(home, lines) if line.holder not in ("h1", "h2", "h3")}
        heavy = _around(regions, (regions[at].parent for at in mass if at))
        while region and region not in spoken and region not in heavy:
            region = regions[region].parent
        if region in spoken or region not in heavy:
            kept = {region}
        else:
            # a region of headings alone: its body is what is nested in it
            kept = {max((at for at in mass if at != region and _inside(regions, at, region)), key=mass.get)}
    elif mass:
        region = max(mass, key=mass.get)
        kept = {region}
    if region is None:
        return [False] * len(lines)
    kept |= _nested(lines, home, content, full, smooth, border, regions, region, kept)
    inside = [i for i, at in enumerate(home) if at in kept and content[i]] or [0]
    # the page itself holds the furniture too
    bare = {at for at in kept if regions[at].tag in ("page", "body")}
    good = [
        i == head or (at in kept and _own(line) and not (at in bare and full[i] and not inside[0] < i < inside[-1]))
        for i, (line, at) in enumerate(zip(lines, home))
    ]
    if region not in kept:
        # headings of the region stand over what follows them
        for i in range(len(lines) - 2, -1, -1):
            good[i] = good[i] or (home[i] == region and lines[i].holder in HEADINGS and not full[i] and good[i + 1] and home[i + 1] != region)
    return good


def content_lines(lines: list[Line], full: list[bool]) -> tuple[list[float], float, list[bool]]:
    """Smoothed ratio of each line, the border between the two clusters, and which lines are content; a link has ratio 0."""
    ratios = [(0.0 if link else float(len(line.text))) / max(1, line.tags) for line, link in zip(lines, full)]
    smooth = smoothed(ratios)
    border = threshold(smooth)
    return smooth, border, [value >= border and value > 0 and not link for value, link in zip(smooth, full)]


def _nested(
    lines: list[Line], home: list[int], content: list[bool], full: list[bool], smooth: list[float], border: float, regions: list[Region], outer: int, kept: set[int]
) -> set[int]:
    """The elements within ``outer`` that belong to its article, each reached by elements that do, or that have no lines.

    An element belongs if its own text is for the greater part content lines, one
    of them by its own ratio, or if all of it is data. A line alone in an element
    that is no section must have three quarters of the usual length of content lines, as
    notices are set so. Furniture, elements of teasers and articles in an article
    or beside another one do not belong.
    """
    own: dict[int, list[int]] = {}
    cells: dict[int, int] = {}
    for i, at in enumerate(home):
        own.setdefault(at, []).append(i)
        if lines[i].holder in ("td", "th"):
            cells[lines[i].table] = cells.get(lines[i].table, 0) + 1
    articles: dict[int, int] = {}
    for at, element in enumerate(regions):
        if element.tag == "article" and not element.furniture:
            articles[element.parent] = articles.get(element.parent, 0) + 1
        if element.tag in ("td", "th") and element.has_blocks:
            cells[element.table] = cells.get(element.table, 0) + 1

    long = [len(line.text) for line, good in zip(lines, content) if good]
    usual = sum(long) / max(1, len(long))
    # where all lines are alike, two clusters would cut between equals
    high = [value for value, good in zip(smooth, content) if good]
    least = min(border, sum(high) / max(1, len(high)) / 2)

    def belongs(at: int) -> bool:
        element, rows = regions[at], own[at]
        heads = sum(lines[i].holder in HEADINGS for i in rows)
        small = sum(lines[i].holder in HEADINGS - {"h1", "h2"} for i in rows)
        text = [i for i in rows if lines[i].holder not in HEADINGS and not full[i]]
        if not text or any(not _own(lines[i]) for i in rows) or 2 * sum(full[i] for i in rows) > len(rows):
            return False
        if all(lines[i].holder in DATA for i in text):
            return True
        if element.tag in ("td", "th") and not heads and element.table and cells.get(element.table, 0) >= LEAST_CELLS:
            return True
        if element.tag != "section" and 2 * small >= len(rows):
            return False
        size = sum(len(lines[i].text) for i in text)
        if element.tag != "section" and len(text) == 1 and size < 0.75 * usual:
            return False
        return 2 * sum(len(lines[i].text) for i in text if smooth[i] >= least) >= size and max(len(lines[i].text) / max(1, lines[i].tags) for i in text) >= least

    in_article = {outer: any(regions[at].tag == "article" for at in _upward(regions, outer))}
    found: set[int] = set()
    headed: list[int] = []
    for at in range(outer + 1, len(regions)):
        element = regions[at]
        if element.parent not in in_article or element.furniture:
            continue
        if element.tag == "article" and at not in kept and (in_article[element.parent] or articles[element.parent] > 1):
            continue
        rows = own.get(at, [])
        if at not in kept and rows:
            if all(lines[i].holder in HEADINGS for i in rows):
                if element.tag != "section" and any(lines[i].holder not in ("h1", "h2") for i in rows):
                    continue
                headed.append(at)
            elif belongs(at):
                found.add(at)
            else:
                continue
        in_article[at] = in_article[element.parent] or element.tag == "article"
    # headings alone count with what they stand over
    for at in reversed(headed):
        if any(_inside(regions, below, at) for below in found | kept):
            found.add(at)
    return found


def _around(regions: list[Region], places: Iterator[int]) -> set[int]:
    """The regions of the places and all around them."""
    found: set[int] = set()
    for at in places:
        while at >= 0 and at not in found:
            found.add(at)
            at = regions[at].parent
    return found


def _upward(regions: list[Region], at: int) -> Iterator[int]:
    while at > 0:
        yield at
        at = regions[at].parent


def _mass(lines: list[Line], home: list[int], counted: list[bool], regions: list[Region]) -> dict[int, float]:
    """Text of the counted lines of each region that is not furniture, less the share of headings: teasers have many."""
    text, heads, rows = {}, {}, {}
    for line, at, good in zip(lines, home, counted):
        if not regions[at].furniture:
            rows[at] = rows.get(at, 0) + 1
            heads[at] = heads.get(at, 0) + (line.holder in ("h2", "h3", "h4", "h5", "h6"))
            if good:
                text[at] = text.get(at, 0.0) + len(line.text)
    return {at: n * (1 - heads[at] / rows[at]) for at, n in text.items() if heads[at] < rows[at]}


def _inside(regions: list[Region], at: int, outer: int) -> bool:
    while at > 0 and at != outer:
        at = regions[at].parent
    return at == outer


def _own(line: Line) -> bool:
    return line.holder not in ("button", "option", "label")


BLOCK_SCHEMA = "src string, row_id bigint, block_no int, is_main boolean, block string"


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row for each block of ``pages(src, row_id, html)``, with its number, text and whether it is main body.

    Null and empty html and pages without text give no rows; html without any
    tag has blocks, none of them main.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, key, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not html:
                    continue
                page = parse(html)
                rows.extend((src, key, no, good, line.text) for no, (line, good) in enumerate(zip(page.lines, main_lines(page))))
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    return pages.select("src", "row_id", "html").mapInArrow(run, BLOCK_SCHEMA)


def pages_of(crawls: DataFrame, requests: DataFrame) -> DataFrame:
    """(src, row_id, html) of all pages that can have a main body, each key in its last loaded delivery.

    A crawl needs status 200 and a content type that is unknown (null or blank)
    or names HTML; null html is left out.
    """
    crawl = (
        latest(crawls.select("crawl_id", "status_code", "content_type", "html", "loaded_at"), "crawl_id", heavy=True)
        .where("status_code = 200 and html is not null")
        .where("content_type is null or trim(content_type) = '' or lower(content_type) like '%html%'")
        .select(F.lit("crawl").alias("src"), F.col("crawl_id").alias("row_id"), "html")
    )
    extract = latest(requests.select("request_id", "html", "loaded_at"), "request_id", heavy=True).where("html is not null")
    return crawl.unionByName(extract.select(F.lit("extract").alias("src"), F.col("request_id").alias("row_id"), "html"))


def main_text(pages: DataFrame) -> DataFrame:
    """(src, row_id, text): the main body of each page, blocks joined by blank lines; pages without one have an empty text."""
    blocks = page_blocks(pages).groupBy("src", "row_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_main"), F.struct("block_no", "block")))), lambda b: b["block"]).alias("blocks")
    )
    return pages.select("src", "row_id").join(blocks, ["src", "row_id"], "left").select("src", "row_id", F.coalesce(F.array_join("blocks", "\n\n"), F.lit("")).alias("text"))
