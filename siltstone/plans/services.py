"""The remaining entry points as plans: cached search, search and ingest, extraction of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.urls import normalize_url
from siltstone.operators import crawl, store
from siltstone.plans import ingest as ingest_plan
from siltstone.plans.embed import Embedder
from siltstone.plans.settings import Settings


def search_key(query, n, engines, safe):
    """Cache key of a web search; the order of the engines does not matter."""
    named = F.array_join(F.array_sort(F.coalesce(engines, F.array().cast("array<string>"))), ",")
    return F.sha2(F.concat_ws(":", query, n.cast("string"), named, safe.cast("string")), 256)


def cached_search(requests: DataFrame, entries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``requests(read_id, query, n, engines, safe, read_at)`` with ``value`` and ``cached``.

    Requests that ``entries(key, value, written_at, expires_at)`` answers come from
    there; each distinct other one goes once through ``search(key, query, n) ->
    (key, value)``.
    """
    keyed = requests.withColumn("key", search_key(F.col("query"), F.col("n"), F.col("engines"), F.col("safe")))
    looked = store.cache_lookup(keyed.select("read_id", "key", "read_at"), entries)
    missing = keyed.join(looked.where("not hit").select("read_id"), "read_id", "left_semi").groupBy("key").agg(F.first("query").alias("query"), F.first("n").alias("n"))
    made = search(missing).select("key", F.col("value").alias("made"))
    return (
        requests.join(looked.select("read_id", "key", "value", "hit"), "read_id")
        .join(made, "key", "left")
        .select(*requests.columns, F.when(F.col("hit"), F.col("value")).otherwise(F.col("made")).alias("value"), F.col("hit").alias("cached"))
    )


def search_and_ingest(hits: DataFrame, pages: DataFrame, collection: DataFrame | None, embedder: Embedder, settings: Settings = Settings()) -> DataFrame:
    """Ingest the pages that search hits ``(url)`` lead to, each page once; hits that cannot be fetched are left out."""
    got = crawl.crawl(hits.where("url is not null").select("url").distinct(), pages).where("error is null")
    once = store.last_in_order(got, "url_key", "final_url")
    return ingest_plan.ingest(collection, once.select(F.col("url_key").alias("page_id"), F.col("final_url").alias("url"), "status_code", "html"), embedder, settings)


def extract(requests: DataFrame, pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(request_id, url, title, text, word_count, error) of ``requests(request_id, html, url)``.

    Without html the page of the url is taken from ``pages``; with neither the
    request is in error. The text is the chunks joined again, so that overlaps
    are in it twice and in the sum of words as well.
    """
    fetched = crawl.crawl(requests.where("html is null and url is not null").select("url").distinct(), pages)
    found = fetched.groupBy("url").agg(F.first("html").alias("found_html"), F.first("error").alias("fetch_error"))
    asked = requests.withColumn("normal", normalize_url(F.col("url"))).join(found.withColumnRenamed("url", "normal"), "normal", "left")
    body = asked.select("request_id", F.col("normal").alias("url"), F.coalesce("html", "found_html").alias("html"), "fetch_error")
    documents = ingest_plan.documents_of(body.select(F.col("request_id").alias("page_id"), "url", F.lit(200).alias("status_code"), "html"), settings)
    split = documents.select(F.col("page_id").alias("request_id"), "title", T.chunks(F.col("text"), settings.chunk_size, settings.chunk_overlap).alias("parts"))
    joined = split.select("request_id", "title", F.array_join("parts", "\n\n").alias("text"), F.aggregate("parts", F.lit(0), lambda n, p: n + T.word_count(p)).alias("word_count"))
    error = F.when(F.col("html").isNull(), F.coalesce("fetch_error", F.lit("needs html or url"))).when(F.col("text").isNull(), "no text")
    return body.join(joined, "request_id", "left").select("request_id", "url", "title", "text", "word_count", error.alias("error"))
