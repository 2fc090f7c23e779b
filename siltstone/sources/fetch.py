"""Fetching of pages over HTTP in tasks, with retries; not usable without a network, tables of pages take its place."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FETCH_SCHEMA = "url string, status_code int, html string, final_url string, content_type string, elapsed_ms double, error string"
Fetch = Callable[[str], tuple[int, str | None, str, str]]


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str | None, str, str]:
    """(status, body or None, final URL, content type); any status is an answer."""
    request = urllib.request.Request(url, headers={"User-Agent": "siltstone"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace") or None, answer.url, answer.headers.get("Content-Type", "")
    except urllib.error.HTTPError as answer:
        return answer.code, answer.read().decode("utf-8", "replace") or None, answer.url, answer.headers.get("Content-Type", "")


def fetch_pages(urls: DataFrame, fetch: Fetch = http_get, at_once: int = 10, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """One row for each row of ``urls(url)``: the answer, or an error after ``tries`` transport errors.

    ``at_once`` bounds the requests that run at a time, as the number of
    partitions. Waits double up to 30 seconds. A null URL carries an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                began, error, answer = time.monotonic(), "no url", (None, None, None, None)
                for attempt in range(tries if url else 0):
                    try:
                        answer, error = fetch(url), None
                        break
                    except OSError as problem:
                        error = f"{type(problem).__name__}: {problem}"
                        if attempt + 1 < tries:
                            time.sleep(min(30.0, wait * 2**attempt))
                    except ValueError as problem:
                        error = f"{type(problem).__name__}: {problem}"
                        break
                rows.append((url, *answer, (time.monotonic() - began) * 1000, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCH_SCHEMA.split(", ")])

    return urls.select("url").repartition(at_once).mapInPandas(run, FETCH_SCHEMA)


def search_hits(responses: DataFrame, n: int = 10) -> DataFrame:
    """(query, rank, url, title, snippet, engine, score) from stored JSON answers (query, body) of a search service.

    The first n results of each; missing texts are '' and a missing engine is
    'unknown'. Malformed answers have no results.
    """
    from pyspark.sql import functions as F

    shape = "struct<results:array<struct<url:string,title:string,content:string,engine:string,score:double>>>"
    hits = responses.select("query", F.posexplode(F.slice(F.from_json("body", shape)["results"], 1, n)).alias("rank", "hit"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return hits.select(
        "query", (F.col("rank") + 1).alias("rank"), blank("hit.url").alias("url"), blank("hit.title").alias("title"),
        blank("hit.content").alias("snippet"), F.coalesce("hit.engine", F.lit("unknown")).alias("engine"), F.col("hit.score").alias("score"),
    )
