"""HTML, robots and sitemap functions; Python only where a parser is needed, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

_STRINGS = ArrayType(StringType())

#: Elements that never hold content, elements without end tag, link schemes that lead nowhere.
NOISE = frozenset(("script", "style", "nav", "footer", "header", "aside", "form", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_LINK = ("#", "mailto:", "tel:", "javascript:")


class _Page(HTMLParser):
    """Title, links, and the text of the first main, article and body element without noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.links: list[str] = []
        self.text: dict[str, list[str]] = {"main": [], "article": [], "body": [], "": []}
        self.open: list[str] = []
        self.noise = 0
        self.done: set[str] = set()
        self.began: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.links.append(href.strip())
        if tag in VOID:
            return
        self.noise += tag in NOISE
        if tag in self.text and tag not in self.done:
            self.began.add(tag)
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while True:
            closed = self.open.pop()
            self.noise -= closed in NOISE
            if closed in self.text and closed not in self.open:
                self.done.add(closed)
            if closed == tag:
                return

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if not data:
            return
        if "title" in self.open:
            self.title = self.title or data
        if self.noise:
            return
        self.text[""].append(data)
        for tag in ("main", "article", "body"):
            if tag in self.open and tag not in self.done:
                self.text[tag].append(data)

    def content(self) -> str:
        tag = next((t for t in ("main", "article", "body") if t in self.began), "")
        return "\n".join(self.text[tag])


def _page(html: str | None) -> _Page | None:
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    return page


@F.pandas_udf(StructType().add("title", StringType()).add("text", StringType()).add("hrefs", _STRINGS))
def parsed(pages: pd.Series) -> pd.DataFrame:
    """Title, main text and raw links of a page; all null for null, empty texts for empty html."""
    rows = [_page(h) for h in pages]
    return pd.DataFrame({"title": [p and p.title for p in rows], "text": [p and p.content() for p in rows], "hrefs": [p and p.links for p in rows]})


@F.pandas_udf(_STRINGS)
def absolute(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    """Links joined to their page, without fragments; malformed ones are dropped."""

    def join(links, page: str | None) -> list[str] | None:
        if links is None or page is None:
            return None
        out = []
        for href in links:
            if href and not href.startswith(NO_LINK):
                try:
                    out.append(urlparse(urljoin(page, href))._replace(fragment="").geturl())
                except ValueError:
                    continue
        return out

    return pd.Series([join(h, b) for h, b in zip(hrefs, base)])


def same_site_links(hrefs: Column, base: Column) -> Column:
    """Distinct links of a page to its own network location, in order of appearance."""
    from siltstone.functions.urls import same_domain

    return F.array_distinct(F.filter(absolute(hrefs, base), lambda u: same_domain(u, base)))


@F.pandas_udf(BooleanType())
def robots_allow(robots: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    """Whether a robots file lets the agent fetch the URL; anything missing or malformed allows."""

    parsed_rules: dict[str, RobotFileParser] = {}

    def allow(text: str | None, page: str | None, name: str | None) -> bool:
        if not text or not page:
            return True
        try:
            rules = parsed_rules.get(text)
            if rules is None:
                # a file that serves many pages of the batch is parsed once
                rules = parsed_rules[text] = RobotFileParser()
                rules.parse(text.splitlines())
            return rules.can_fetch(name or "*", page)
        except Exception:
            return True

    return pd.Series([allow(*x) for x in zip(robots, url, agent)])


_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


@F.pandas_udf(StructType().add("kind", StringType()).add("locations", _STRINGS))
def sitemap(xml: pd.Series) -> pd.DataFrame:
    """'urlset' or 'sitemapindex' with its locations; other and malformed documents have no locations."""
    from xml.etree import ElementTree

    kinds, places = [], []
    for text in xml:
        kind, found = None, []
        try:
            root = ElementTree.fromstring(text or "")
            for name, child in (("urlset", "url"), ("sitemapindex", "sitemap")):
                if root.tag == f"{{{_NAMESPACE}}}{name}":
                    kind = name
                    found = [x.text.strip() for x in root.iterfind(f"{{{_NAMESPACE}}}{child}/{{{_NAMESPACE}}}loc") if x.text and x.text.strip()]
        except ElementTree.ParseError:
            pass
        kinds.append(kind)
        places.append(found)
    return pd.DataFrame({"kind": kinds, "locations": places})
