"""Schemas of the tables, and the statements that create them."""

from __future__ import annotations

from pyspark.sql import SparkSession

PAGES = "page_id BIGINT, url STRING, final_url STRING, status_code INT, html STRING, content_type STRING, fetched_at TIMESTAMP"
CHUNKS = (
    "collection STRING, point_id STRING, url STRING, chunk_index INT, total_chunks INT, word_count INT, title STRING, author STRING, "
    "date STRING, language STRING, text STRING, fp STRING, extra MAP<STRING, STRING>, embedding ARRAY<FLOAT>"
)
POSTINGS = "collection STRING, point_id STRING, term_id BIGINT, tf INT, dl INT"
TERM_COUNTS = "collection STRING, term_id BIGINT, df BIGINT"
COLLECTION_STATS = "collection STRING, n_docs BIGINT, avgdl DOUBLE"
CRAWL_STATE = "url STRING, url_hash STRING, status STRING, http_status SMALLINT, crawled_at TIMESTAMP, error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
JOBS = "job_id STRING, job_type STRING, status STRING, payload STRING, result STRING, error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
CACHE = "key STRING, value STRING, written_at TIMESTAMP, expires_at TIMESTAMP"

#: table -> (schema, partition columns)
TABLES = {
    "pages": (PAGES, ()),
    "chunks": (CHUNKS, ("collection",)),
    "postings": (POSTINGS, ("collection",)),
    "term_counts": (TERM_COUNTS, ("collection",)),
    "collection_stats": (COLLECTION_STATS, ()),
    "crawl_state": (CRAWL_STATE, ()),
    "jobs": (JOBS, ()),
    "cache": (CACHE, ()),
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that do not exist yet; gives the names of those created."""
    made = []
    for name, (schema, partitions) in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
            spark.sql(f"CREATE TABLE {database}.{name} ({schema}) USING parquet{by}")
            made.append(name)
    return made


def collection_layout(spark: SparkSession, table: str) -> str:
    """'missing', 'hybrid' for a table with postings or sparse weights beside vectors, or 'dense'."""
    if not spark.catalog.tableExists(table):
        return "missing"
    names = {f.name for f in spark.table(table).schema}
    return "hybrid" if {"sparse_indices", "sparse_values"} <= names or "text" in names else "dense"
