"""Crawling over a table of pages: cache, robots rules, fallback fetch, links, and the breadth-first walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions.urls import domain, normalize_url, url_key
from siltstone.sources.tables import ensure_checkpoint_dir

#: Answers that call for the browser, and the least length of a page that counts as loaded.
BLOCKED, LEAST_HTML = (403, 406, 429), 500
LINKS_A_PAGE, MAX_PAGES, SITEMAP_URLS, SITEMAP_CHILDREN = 25, 100, 500, 20


def needs_browser(status: Column, html: Column) -> Column:
    """Whether a page should be fetched again by a browser: blocked, no answer, or suspiciously short."""
    n = F.length(F.coalesce(html, F.lit("")))
    return F.coalesce(status.isin(*BLOCKED) | (status == 0) | ((n > 0) & (n < LEAST_HTML)), F.lit(True))


def distinct_urls(urls: DataFrame, url: str = "url", order: str = "place") -> DataFrame:
    """The first row of each page by ``order``; spellings that normalise alike are one page. Null URLs are dropped."""
    w = Window.partitionBy("url_key").orderBy(order, url)
    keyed = urls.where(F.col(url).isNotNull()).withColumn("url_key", url_key(F.col(url)))
    return keyed.withColumn("first", F.row_number().over(w)).where("first = 1").drop("first")


def crawl(urls: DataFrame, pages: DataFrame, robots: DataFrame | None = None, agent: str = "*", use_browser: bool = False, browser_pages: DataFrame | None = None) -> DataFrame:
    """Fetch ``urls(url)`` from ``pages(url_key, status_code, html, final_url)``: one row for each with an error or a page.

    URLs are normalised first and reported so; repeated ones are fetched each.
    ``robots(netloc, robots)`` may block; without rules, or with malformed ones,
    everything is allowed. With ``use_browser``, pages that need it come from
    ``browser_pages`` where those have them. Unknown pages carry an error.
    """
    asked = urls.select(normalize_url(F.col("url")).alias("url")).withColumn("url_key", F.sha2("url", 256))
    asked = asked.withColumn("netloc", domain(F.col("url")))
    if robots is not None:
        asked = asked.join(robots.groupBy("netloc").agg(F.max("robots").alias("robots")), "netloc", "left")
        asked = asked.withColumn("allowed", H.robots_allow(F.col("robots"), F.col("url"), F.lit(agent))).drop("robots")
    else:
        asked = asked.withColumn("allowed", F.lit(True))
    found = asked.join(pages.select("url_key", "status_code", "html", "final_url", F.lit(True).alias("known")), "url_key", "left")
    if use_browser and browser_pages is not None:
        again = browser_pages.select("url_key", F.col("status_code").alias("b_status"), F.col("html").alias("b_html"), F.col("final_url").alias("b_url"), F.lit(True).alias("b_known"))
        found = found.join(again, "url_key", "left").withColumn("by_browser", F.col("b_known").isNotNull() & needs_browser(F.col("status_code"), F.col("html")))
        for column, other in (("status_code", "b_status"), ("html", "b_html"), ("final_url", "b_url"), ("known", "b_known")):
            found = found.withColumn(column, F.when(F.col("by_browser"), F.col(other)).otherwise(F.col(column)))
    else:
        found = found.withColumn("by_browser", F.lit(False))
    known = F.coalesce("known", F.lit(False)) & F.coalesce("allowed", F.lit(True))
    return found.select(
        "url", "url_key",
        *[F.when(known, F.col(c)).alias(c) for c in ("status_code", "html", "final_url")],
        (known & F.col("by_browser")).alias("used_browser"),
        F.when(~F.coalesce("allowed", F.lit(True)), "blocked by robots.txt").when(~known, "not found").alias("error"),
    )


def page_links(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(url, place, link): the links of each page to its own site, distinct, in order of appearance; with ``most``, the first so many."""
    links = pages.select("url", "base", H.parsed(F.col("html"))["hrefs"].alias("hrefs")).select("url", H.same_site_links(F.col("hrefs"), F.col("base")).alias("links"))
    return links.select("url", F.posexplode("links" if most is None else F.slice("links", 1, most)).alias("place", "link"))


def walk(seeds: DataFrame, links: DataFrame, depth: int | None = 1, budget: int | None = MAX_PAGES) -> DataFrame:
    """(url, level, place): breadth-first from ``seeds(url)`` over ``links(url, place, link)``, level 0 for the seeds.

    A page is visited once, on the level where it is found first. Without depth
    the walk ends where no page is new. With a budget,
    each level takes its first pages by order of discovery until so many have
    been visited; what is left over is not taken up again. Discovery order is the
    place of the parent, then of the link, then the URL. One job for a level,
    the visited set is cut by checkpoints.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    order = Window.orderBy("parent_place", "place", "url")
    start = seeds.where("url is not null").groupBy("url").agg(F.lit(0).alias("parent_place"), F.lit(0).alias("place"))
    found, seen, level, left = start, start.select("url"), 0, budget
    visited: DataFrame | None = None
    while True:
        if left is not None:
            # the budget bounds what is ordered: only that many rows pass the limit
            found = found.orderBy("parent_place", "place", "url").limit(left)
            now = found.withColumn("number", F.row_number().over(order) - 1)
        else:
            now = found.withColumn("number", F.xxhash64("url"))
        now = now.select("url", F.lit(level).alias("level"), "number").checkpoint()
        n = now.count()
        visited = now if visited is None else visited.unionByName(now)
        left = None if left is None else left - n
        if n == 0 or level == depth or left == 0:
            return visited.select("url", "level", F.col("number").alias("place"))
        fresh = links.join(now.select("url", F.col("number").alias("parent_place")), "url").select(F.col("link").alias("url"), "parent_place", "place")
        first = fresh.groupBy("url").agg(F.min(F.struct("parent_place", "place")).alias("at")).select("url", "at.*")
        # a page found but left out for lack of budget counts as seen too
        found = first.join(seen, "url", "left_anti").checkpoint()
        seen = seen.unionByName(found.select("url"))
        level += 1


#: Where a site may keep its sitemaps, in the order they are tried, and how deep indexes are followed.
SITEMAP_PATHS, SITEMAP_DEPTH = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"), 2


def discovered_urls(sites: DataFrame, documents: DataFrame, depth: int = SITEMAP_DEPTH, urls: int | None = SITEMAP_URLS, children: int | None = SITEMAP_CHILDREN) -> DataFrame:
    """(site, url, number): the locations of each site's sitemaps, distinct, in the order in which a walk finds them.

    ``sites(site)`` are URLs of which only scheme and network location count,
    ``documents(url, xml)`` the fetched sitemaps. The walk tries SITEMAP_PATHS one
    after the other and follows the first ``children`` entries of an index before
    what comes after it, to ``depth`` levels, each sitemap once. The first ``urls``
    locations of each site remain. None lifts either limit. One job for a level;
    places are paths, so that their order is that of the walk.
    """
    ensure_checkpoint_dir(sites.sparkSession)
    origin = F.lower(F.regexp_extract("site", r"(?i)^\s*(https?://[^/?#\s]+)", 1))
    roots = sites.select(origin.alias("site")).where("site <> ''").distinct()
    now = roots.select("site", F.posexplode(F.array(*[F.concat("site", F.lit(p)) for p in SITEMAP_PATHS])).alias("place", "sitemap")).select("site", "sitemap", F.array("place").alias("path"))
    seen, found = None, None
    for level in range(depth + 1):
        first = now.groupBy("site", "sitemap").agg(F.min("path").alias("path"))
        if seen is not None:
            first = first.join(seen, ["site", "sitemap"], "left_anti")
        seen = first.select("site", "sitemap") if seen is None else seen.unionByName(first.select("site", "sitemap"))
        maps = first.join(documents.select(F.col("url").alias("sitemap"), "xml"), "sitemap").select("site", "path", H.sitemap(F.col("xml")).alias("map")).checkpoint()
        entries = lambda kind: maps.where(F.col("map.kind") == kind)
        placed = entries("urlset").select("site", "path", F.posexplode("map.locations").alias("pos", "url")).select("site", "url", F.concat("path", F.array("pos")).alias("path"))
        found = placed if found is None else found.unionByName(placed)
        inner = F.col("map.locations") if children is None else F.slice("map.locations", 1, children)
        now = entries("sitemapindex").select("site", "path", F.posexplode(inner).alias("pos", "sitemap")).select("site", "sitemap", F.concat("path", F.array("pos")).alias("path"))
        if level < depth and now.isEmpty():
            break
    once = found.groupBy("site", "url").agg(F.min("path").alias("path"))
    numbered = once.withColumn("number", F.row_number().over(Window.partitionBy("site").orderBy("path")) - 1).drop("path")
    return numbered if urls is None else numbered.where(F.col("number") < urls)


def sitemap_urls(documents: DataFrame, most: int | None = SITEMAP_URLS) -> DataFrame:
    """(url, place): locations of the urlset documents of ``documents(place, xml)``, distinct; the first ``most``, or all."""
    parsed = documents.select("place", H.sitemap(F.col("xml")).alias("map")).where(F.col("map.kind") == "urlset")
    every = parsed.select(F.col("place").alias("doc"), F.posexplode("map.locations").alias("pos", "url"))
    first = every.groupBy("url").agg(F.min(F.struct("doc", "pos")).alias("at"))
    return (first if most is None else first.orderBy("at").limit(most)).select("url", F.col("at.doc").alias("place"))


def sitemap_children(documents: DataFrame, most: int | None = SITEMAP_CHILDREN) -> DataFrame:
    """(place, child): the locations of each sitemap index; the first ``most``, or all."""
    parsed = documents.select("place", H.sitemap(F.col("xml")).alias("map")).where(F.col("map.kind") == "sitemapindex")
    return parsed.select("place", F.explode("map.locations" if most is None else F.slice("map.locations", 1, most)).alias("child"))
