"""Ingest: pages to cleaned documents, chunks, postings and vectors, and the new state of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.operators import store
from siltstone.plans.embed import Embedder
from siltstone.plans.settings import Settings


def documents_of(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, title, text, word_count) of ``pages(page_id, url, status_code, html)``; pages without text are dropped.

    Status codes are ignored unless ``require_ok``.
    """
    held = pages.where("html is not null and html <> ''")
    if settings.require_ok:
        held = held.where("status_code = 200")
    page = held.select("page_id", "url", H.parsed(F.col("html")).alias("page"))
    # a generator is computed once, where a filter on a computed column would compute it again
    text = F.explode(F.filter(F.array(T.cleaned(F.col("page.text"))), lambda t: t != "")).alias("text")
    return page.select("page_id", "url", "page.title", text).withColumn("word_count", T.word_count(F.col("text")))


def failures_of(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, error) of the pages that documents_of drops: their status, no html, or no text in it."""
    parsed = documents_of(pages, settings).select("page_id", F.lit(True).alias("has_text"))
    html = F.coalesce("html", F.lit("")) == ""
    status = ~F.coalesce(F.col("status_code") == 200, F.lit(False)) if settings.require_ok else F.lit(False)
    error = F.when(status, F.concat(F.lit("status "), F.coalesce(F.col("status_code").cast("string"), F.lit("unknown")))).when(html, "no html").otherwise("no text")
    return pages.join(parsed, "page_id", "left").where("has_text is null").select("page_id", "url", error.alias("error"))


def chunks_of(documents: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each chunk of ``documents(url, title, text, *keep)`` with its point id and fingerprint."""
    split = documents.select("url", "title", *keep, T.chunks(F.col("text"), settings.chunk_size, settings.chunk_overlap).alias("chunks"))
    rows = split.select("url", "title", *keep, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    return rows.withColumn("word_count", T.word_count(F.col("text"))).withColumn("fp", T.fingerprint(F.col("text"))).withColumn("point_id", T.point_id(F.col("url"), F.col("chunk_index")))


def ingest(collection: DataFrame | None, pages: DataFrame, embedder: Embedder, settings: Settings = Settings()) -> DataFrame:
    """The points of a collection after ``pages`` were ingested: all points of their URLs are replaced.

    Ingesting the same pages again gives the same points.
    """
    new = chunks_of(documents_of(pages, settings), settings, keep=("page_id",)).withColumn("embedding", embedder(F.col("text")))
    return store.last_in_order(new, "point_id", "page_id") if collection is None else store.replace_by_url(collection, new, "page_id")
